"""Exact ranks in a total order without a window over all rows.

Rows are range-partitioned and sorted, so a row's place within its slice is
known to its task; what lies before a slice is a prefix sum over one row for each slice and
group.  No task holds more than a slice, also where one group has most rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from payrecheck.session import stage

#: ``monotonically_increasing_id`` counts rows of a partition in its lower bits.
_SLICE_BITS = 33


def with_rank(
    rows: DataFrame,
    order: Sequence[Column],
    within: Sequence[str] = (),
    rank: str = "rank",
    size: str | None = None,
    group: str | None = None,
) -> DataFrame:
    """``rows`` with ``rank``, from 0, by ``order`` within each group.

    ``within``: columns of the groups, nulls being a group of their own; groups follow
    each other in ascending order, nulls first.  ``size``: name of a column for the number
    of rows of the group; ``group``: name of one for the group's own rank, from 0.
    Rows equal in the whole order get ranks in no certain order, fixed by the written
    table.  Writes the sorted rows once.
    """
    by = [F.col(c).asc_nulls_first() for c in within] + list(order)
    held = stage(
        rows.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("_at", F.monotonically_increasing_id()),
        "ranked",
    )
    slice_ = F.shiftright("_at", _SLICE_BITS).alias("_slice")
    row = F.col("_at").bitwiseAND(F.lit((1 << _SLICE_BITS) - 1)).alias("_row")
    held = held.select(*rows.columns, slice_, row)
    keys = [f"_g{k}" for k in range(len(within))]
    named = [F.col(c).alias(k) for c, k in zip(within, keys, strict=True)]
    # One row for each slice and group: at most slices + groups.
    runs = stage(
        held.groupBy("_slice", *named).agg(
            F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first")
        ),
        "runs",
    )
    own = Window.partitionBy(*keys)
    earlier = own.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    facts = runs.select(
        F.col("_slice").alias("_s"),
        *keys,
        "_first",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(own).alias("_size"),
    )
    if group:
        facts = _group_ranks(facts, keys)
    same = reduce(
        lambda a, b: a & b,
        [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(within, keys, strict=True)],
        F.col("_slice") == F.col("_s"),
    )
    out = [(F.col("_before") + F.col("_row") - F.col("_first")).alias(rank)]
    out += [F.col("_size").alias(size)] if size else []
    out += [F.col("_group").alias(group)] if group else []
    return held.join(facts, same).select(*rows.columns, *out)


def _group_ranks(facts: DataFrame, keys: list[str]) -> DataFrame:
    """``facts`` with ``_group``: groups in the order in which the slices meet them."""
    starts = stage(facts.filter(F.col("_before") == 0).select("_s", *keys, "_first"), "starts")
    slices = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    # As many rows as slices.
    earlier = (
        starts.groupBy("_s")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_s", F.coalesce(F.sum("_n").over(slices), F.lit(0)).alias("_earlier"))
    )
    number = F.row_number().over(Window.partitionBy("_s").orderBy("_first")) - 1
    numbered = (
        starts.withColumn("_number", number)
        .join(earlier, "_s")
        .select(
            *[F.col(k).alias(f"{k}_") for k in keys],
            (F.col("_earlier") + F.col("_number")).alias("_group"),
        )
    )
    same = reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys],
        F.lit(True),
    )
    return facts.join(numbered, same).drop(*[f"{k}_" for k in keys])
