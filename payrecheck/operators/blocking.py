"""Candidate pairs from blocking keys.

Payments that share a key are compared with each other, all of them.  A key with
more than ``TILE`` payments is divided into slices by a hash of the id, and every
two slices make a tile of their own, so a hot key's comparisons are spread over many
tasks and no task holds the key.  ``blocking_stats`` tells the number of pairs before a
run, and ``key_groups`` says in linear size which payments share a key.

With an explicit ``cap`` a key is divided instead of compared in full: by
invoice date, and a date with more than ``cap`` payments into runs of ``cap`` in
``transaction_id`` order.  The cap is then part of what the result *means*, and
``uncompared`` lists what it left out.

No step relies on a key being small:

* key sizes come from a map-side combined count of 8-byte key hashes;
* only payments under a large key take the splitting path; capped, they are
  range-partitioned by ``(key, date, id)``, so that one key with a third of all
  payments is spread over a third of the tasks;
* positions inside a capped key are local row numbers plus the counts of the
  slices before, so no window ever spans more than one slice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from payrecheck.functions.money import pairs
from payrecheck.operators.signals import (
    CARRIED,
    PAYLOAD,
    SignalSpec,
    default_signals,
    explode_keys,
)
from payrecheck.schema import BLOCKING_STAGE, MONEY, Capabilities
from payrecheck.session import stage

# Payments of a slice of a large key; two slices are compared in one group.
TILE = 200
# A key with more than this share of all rows is "heavy".  There can be at most
# 1 / share of them, whatever the data, so they may always be broadcast.
HEAVY_SHARE = 1e-4

BUCKET = ("family", "key", "sub", "chunk")
_DAY = ("family", "key", "day")


def _payload(keys: DataFrame) -> list[str]:
    """What a payment is compared by, and its carried row where there is one."""
    return [*PAYLOAD, *(c for c in (CARRIED,) if c in keys.columns)]


def _over_cap_hashes(keys: DataFrame, cap: int) -> DataFrame:
    counts = keys.groupBy("key_hash").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") > cap)


def _mark_over_cap(keys: DataFrame, hashes: DataFrame, total: int) -> DataFrame:
    """Add ``_n``: the size of the row's key hash where it is in ``hashes``.

    ``total``: the rows under all of them, a lower bound of all rows, so that 1 / share
    bounds the number of heavy keys.
    """
    is_heavy = F.col("n") > F.lit(int(total * HEAVY_SHARE))
    heavy = hashes.filter(is_heavy).withColumnRenamed("n", "_heavy")
    light = hashes.filter(~is_heavy).select(
        F.col("key_hash").alias("_probe"), F.col("n").alias("_light")
    )
    marked = keys.join(F.broadcast(heavy), "key_hash", "left")
    # Heavy rows are settled; scatter them by id instead of piling them up in
    # the partition of their key.
    probe = F.when(F.col("_heavy").isNull(), F.col("key_hash")).otherwise(
        F.xxhash64("transaction_id")
    )
    return (
        marked.withColumn("_probe", probe)
        .join(light, "_probe", "left")
        .withColumn("_n", F.coalesce("_heavy", "_light"))
        .drop("_probe", "_heavy", "_light")
    )


def _split_over_cap(rows: DataFrame, cap: int) -> DataFrame:
    """Exact ``sub`` and ``chunk`` for payments whose key is over the cap."""
    sliced = stage(
        rows.repartitionByRange(*_DAY, "transaction_id").withColumn(
            "slice", F.spark_partition_id()
        ),
        "blocking-slices",
    )
    # From here on a row count is at most one per (key, date, slice).
    per_slice = sliced.groupBy(*_DAY, "slice").agg(F.count(F.lit(1)).alias("_here"))
    by_day = W.partitionBy(*_DAY)
    earlier = by_day.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    sizes = per_slice.select(
        *_DAY,
        "slice",
        F.coalesce(F.sum("_here").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_here").over(by_day).alias("_in_day"),
        F.sum("_here").over(W.partitionBy("family", "key")).alias("_in_key"),
    )
    in_slice = W.partitionBy(*_DAY, "slice").orderBy("transaction_id")
    numbered = sliced.withColumn("_row", F.row_number().over(in_slice)).join(
        sizes, [*_DAY, "slice"]
    )
    # Equal hashes of different keys can bring a key here that is not over cap.
    over = F.col("_in_key") > cap
    run = F.expr(f"(_before + _row - 1) div {int(cap)}")
    return numbered.select(
        "family",
        "key",
        F.when(over, F.col("day")).otherwise("").alias("sub"),
        F.when(over & (F.col("_in_day") > cap), run).otherwise(F.lit(0).cast("long"))
        .alias("chunk"),
        *_payload(rows),
    )


def _whole(keys: DataFrame, *extra: Column) -> DataFrame:
    """Every key as one bucket."""
    zero = F.lit(0).cast("long")
    return keys.select(
        "family", "key", F.lit("").alias("sub"), zero.alias("chunk"), *_payload(keys), *extra
    )


def _divided(keys: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of keys up to ``limit``, and the others with their key's size ``_n``.

    Runs one job up front: which keys are large.
    """
    hashes = stage(_over_cap_hashes(keys, limit), "large-keys")
    total = hashes.agg(F.sum("n")).first()[0]
    if total is None:
        return keys, None
    marked = _mark_over_cap(keys, hashes, total)
    return marked.filter("_n IS NULL").drop("_n"), marked.filter("_n IS NOT NULL")


def assign_buckets(keys: DataFrame, cap: int | None = None) -> DataFrame:
    """Key rows with their bucket: ``family, key, sub, chunk`` and the payload."""
    if cap is None:
        return _whole(keys)
    if cap < 1:
        raise ValueError(f"the bucket cap must be a positive integer, got {cap}")
    small, large = _divided(keys, cap)
    whole = _whole(small)
    return whole if large is None else whole.unionByName(_split_over_cap(large.drop("_n"), cap))


def _tiles(large: DataFrame) -> DataFrame:
    """Each payment once for every slice of its key: the groups of two slices it is in."""
    slices = F.ceil(F.col("_n") / TILE).cast("int")
    own = F.pmod(F.xxhash64(F.lit(29), "transaction_id"), F.col("_slices")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))
    low, high = F.least("slice", "_other"), F.greatest("slice", "_other")
    return (
        large.withColumn("_slices", slices)
        .withColumn("slice", own)
        .withColumn("_other", other)
        .select(
            "family",
            "key",
            F.lit("tile").alias("sub"),
            (low.cast("long") * F.col("_slices") + high).alias("chunk"),
            *_payload(large),
            F.when(low != high, F.col("slice")).alias("slice"),
        )
    )


def key_pairs(keys: DataFrame, cap: int | None = None) -> DataFrame:
    """``family, l, r`` for each unordered pair under one key, or of one capped bucket."""
    if cap is not None:
        return bucket_pairs(assign_buckets(keys, cap))
    small, large = _divided(keys, TILE)
    buckets = _whole(small, F.lit(None).cast("int").alias("slice"))
    return bucket_pairs(buckets if large is None else buckets.unionByName(_tiles(large)))


def bucket_pairs(buckets: DataFrame) -> DataFrame:
    """``family, l, r`` for each unordered pair inside a bucket (of bounded size).

    Rows with a ``slice`` are paired with those of the other slice only.  One
    exchange on the bucket serves the count that drops single payments and
    the grouping; both sides of a pair come out of it, so nothing is joined.
    """
    sliced = [c for c in ("slice",) if c in buckets.columns]
    shared = buckets.withColumn(
        "_n", F.count(F.lit(1)).over(W.partitionBy(*BUCKET))
    ).filter("_n > 1")
    members = shared.groupBy(*BUCKET).agg(
        F.sort_array(F.collect_list(F.struct(*_payload(buckets), *sliced))).alias("members")
    )
    firsts = members.select(
        "family", "members", F.posexplode("members").alias("pos", "l")
    )
    rest = F.slice("members", F.col("pos") + 2, F.size("members"))
    pair = F.col("l.transaction_id") < F.col("r.transaction_id")
    if sliced:
        pair &= F.col("l.slice").isNull() | (F.col("l.slice") != F.col("r.slice"))
    return firsts.select("family", "l", F.explode(rest).alias("r")).filter(pair)


def uncompared(
    payments: DataFrame,
    cap: int,
    capabilities: Capabilities = Capabilities(),
    signals: tuple[SignalSpec, ...] | None = None,
) -> DataFrame:
    """``family, key, payments, pairs_not_compared`` of the keys that ``cap`` divides."""
    chosen = default_signals(capabilities) if signals is None else signals
    sizes = (
        assign_buckets(explode_keys(payments, chosen), cap)
        .groupBy(*BUCKET)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    left_out = pairs(F.col("payments")) - F.col("compared")
    return (
        sizes.groupBy("family", "key")
        .agg(F.sum("n").alias("payments"), F.sum(pairs(F.col("n"))).alias("compared"))
        .select("family", "key", "payments", left_out.cast("long").alias("pairs_not_compared"))
        .filter("pairs_not_compared > 0")
    )


def key_groups(
    payments: DataFrame,
    capabilities: Capabilities = Capabilities(),
    signals: tuple[SignalSpec, ...] | None = None,
) -> DataFrame:
    """``family, key, transaction_id`` of every key that several payments share.

    As long as the payments, where the pairs of a key grow with the square of its size.
    """
    chosen = default_signals(capabilities) if signals is None else signals
    keys = explode_keys(payments, chosen)
    shared = keys.groupBy("family", "key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return keys.join(shared, ["family", "key"], "left_semi").select(
        "family", "key", "transaction_id"
    )


def candidate_id(signal: Column, left_id: Column, right_id: Column) -> Column:
    return F.concat_ws(":", signal, left_id, right_id)


def score_pairs(pairs_df: DataFrame, signals: tuple[SignalSpec, ...]) -> DataFrame:
    """One candidate per pair and signal that accepts it."""

    def left(field: str) -> Column:
        return F.col(f"l.{field}")

    def right(field: str) -> Column:
        return F.col(f"r.{field}")

    def hit(s: SignalSpec) -> Column:
        return F.struct(
            F.lit(s.name).alias("signal"), s.risk(left, right).cast(MONEY).alias("risk")
        )

    # A pair makes a row for the signals of its own family only.
    hits = F.coalesce(
        *[
            F.when(F.col("family") == family, F.array(*[hit(s) for s in signals if s.family == family]))
            for family in dict.fromkeys(s.family for s in signals)
        ]
    )
    left_id, right_id = left("transaction_id"), right("transaction_id")
    carried = CARRIED in pairs_df.schema["l"].dataType.names
    sides = [side(CARRIED).alias(n) for side, n in ((left, "l"), (right, "r")) if carried]
    return (
        pairs_df.select(
            left_id.alias("left_id"),
            right_id.alias("right_id"),
            *sides,
            F.explode(hits).alias("hit"),
        )
        .filter("hit.risk IS NOT NULL")
        .select(
            candidate_id(F.col("hit.signal"), F.col("left_id"), F.col("right_id")).alias(
                "candidate_id"
            ),
            "left_id",
            "right_id",
            F.col("hit.signal").alias("signal"),
            F.col("hit.risk").alias("amount_at_risk"),
            F.lit(BLOCKING_STAGE).alias("stage_generated"),
            *(["l", "r"] if carried else []),
        )
    )


def block(
    payments: DataFrame,
    capabilities: Capabilities = Capabilities(),
    cap: int | None = None,
    signals: tuple[SignalSpec, ...] | None = None,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Candidate pairs of ``payments`` (unique ``transaction_id``) per signal.

    ``carry``: fields that come along as structs ``l`` and ``r``.  There can be far more candidates
    than payments; these then cross the exchange of blocking instead of each candidate
    crossing two more to find its payments again (``lookup.attach_pair``).
    """
    chosen = default_signals(capabilities) if signals is None else signals
    keys = explode_keys(payments, chosen, carry) if carry else explode_keys(payments, chosen)
    return score_pairs(key_pairs(keys, cap), chosen)


def blocking_stats(
    payments: DataFrame,
    capabilities: Capabilities = Capabilities(),
    cap: int | None = None,
    signals: tuple[SignalSpec, ...] | None = None,
) -> DataFrame:
    """One row: payments in, largest bucket, pair comparisons over all signals.

    A bucket shared by several signals counts once per signal.
    """
    chosen = default_signals(capabilities) if signals is None else signals
    per_family = {s.family: sum(o.family == s.family for o in chosen) for s in chosen}
    weight = reduce(
        lambda expr, item: expr.when(F.col("family") == item[0], F.lit(item[1])),
        list(per_family.items())[1:],
        F.when(
            F.col("family") == next(iter(per_family)),
            F.lit(next(iter(per_family.values()))),
        ),
    )
    sizes = (
        assign_buckets(explode_keys(payments, chosen), cap)
        .groupBy(*BUCKET)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    zero = F.lit(0).cast("long")
    work = sizes.agg(
        zero.alias("rows_in"),
        F.coalesce(F.max("n"), zero).alias("max_bucket"),
        F.coalesce(F.sum(pairs(F.col("n")) * weight).cast("long"), zero).alias(
            "pair_comparisons"
        ),
    )
    rows = payments.agg(
        F.count(F.lit(1)).alias("rows_in"),
        zero.alias("max_bucket"),
        zero.alias("pair_comparisons"),
    )
    return rows.unionByName(work).agg(
        *[F.sum(c).alias(c) for c in ("rows_in", "max_bucket", "pair_comparisons")]
    )


def candidates_by_signal(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("signal").agg(F.count(F.lit(1)).alias("candidates"))
