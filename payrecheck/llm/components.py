"""Connected components of a table of links, by alternating star contractions.

Every step is a grouped minimum and an equi-join on a node: a node with very many
links is summed on the map side and its join can be split, so it never meets in
one task.  Each round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payrecheck.session import stage


#: Far more than star contraction takes; an unfinished result is never returned.
ROUNDS = 99


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Point the larger (or, small star, the smaller) neighbours at the least node near."""
    both = links.select("u", "v")
    both = both.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.filter("v < u")
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = near.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
            least.select("u", F.col("m").alias("v"))
        )
    return out.filter("u <> v").distinct()


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """node, component (the least node it reaches) of all nodes of ``links`` (u, v).

    Raises if the state has not repeated after ``ROUNDS`` rounds.
    """
    now = stage(links.filter("u <> v").select("u", "v").distinct(), f"{name}-0")
    state = None
    for k in range(1, ROUNDS + 1):
        after = stage(_star(_star(now, True), False), f"{name}-{k}")
        seen = after.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if seen == state:
            break
        now, state = after, seen
    else:
        raise RuntimeError(f"components of {name} are not complete after {ROUNDS} rounds")
    return after.select(F.col("u").alias("node"), F.col("v").alias("component"))
