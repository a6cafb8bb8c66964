"""Sharding by a two-pass external shuffle.

Pass one scatters the records uniformly into buckets that fit in memory, by
a seeded hash of each record's place in the input: copies, or a key that many records
share, spread like any others.  Pass two shuffles each bucket with Spark's ``shuffle``
(Fisher-Yates) and writes it.  A record's place in the whole order is its bucket's
offset and its place in the bucket; shard and slot are that place modulo and
divided by the number of shards, so counts differ by one at most and slots have no
gaps.

Only DataFrame functions run here.  ``docs`` must be a stored table.  Of Parquet files a record's
place is its file's name and its row there, and the number of buckets follows from the bytes alone, so
one seed and table give one order on any cluster.  Other inputs have the order of their partitions,
which must be the same when a task runs again.  The shuffled buckets are written before offsets are
taken from them, so no part of the result can mix two orders.

Defined results: a null text has size 1 and the checksum of an empty one; repeated
rows, null ids and empty texts are records like others; an empty table gives
no rows; other columns are carried through by ``shuffle_records``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from payrecheck.session import stage


#: Buckets whose offsets may be broadcast; more meet their records by a shuffle.
BROADCAST_BUCKETS = 1_000_000
#: Buckets of an input that would fit in fewer.
LEAST_BUCKETS = 64


@dataclass(frozen=True)
class ShardRule:
    shards: int = 16
    seed: int = 20240501
    #: What the records of one bucket take in memory, on average.
    bucket_bytes: int = 16 << 20


def _bucket_count(docs: DataFrame, rule: ShardRule) -> int:
    texts = [c for c, t in docs.dtypes if t == "string"]
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(64))
    total = docs.agg(F.sum(size)).first()[0] or 0
    # Small inputs take several buckets as well, so that all cores are used.
    return max(1, -(-total // rule.bucket_bytes), min(LEAST_BUCKETS, total // 4096))


def _placed(docs: DataFrame, rule: ShardRule) -> DataFrame:
    """record, place: a seeded hash of where the record stands in the input."""
    record = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record")
    try:
        held = docs.select(
            record,
            F.col("_metadata.file_name").alias("file"),
            F.col("_metadata.row_index").alias("row"),
        )
    except AnalysisException:
        held = docs.select(record, F.lit("").alias("file")).withColumn(
            "row", F.monotonically_increasing_id()
        )
    return held.select("record", F.xxhash64(F.lit(rule.seed), "file", "row").alias("place"))


def shuffle_records(docs: DataFrame, rule: ShardRule = ShardRule()) -> DataFrame:
    """``docs`` with ``shard`` (int) and ``slot`` (long) in a uniformly random order."""
    names = docs.columns
    buckets = _bucket_count(docs, rule)
    scattered = (
        _placed(docs, rule)
        .withColumn("bucket", F.pmod("place", F.lit(buckets)).cast("int"))
        .repartition(buckets, "bucket")
    )
    shuffled = (
        scattered.groupBy("bucket")
        # Sorted first, so that the order they came in over the network has no part in it.
        .agg(F.array_sort(F.collect_list(F.struct("place", "record"))).alias("records"))
        .sortWithinPartitions("bucket")
        .select(
            "bucket",
            F.size("records").cast("long").alias("n"),
            F.posexplode(F.shuffle("records", rule.seed)).alias("at", "entry"),
        )
        .select("bucket", "n", "at", "entry.record.*")
        .toDF("_bucket", "_n", "_at", *[f"c{k}" for k in range(len(names))])
    )
    written = stage(shuffled, "shuffled-buckets")
    # One row a bucket: the running sum is small whatever the input.
    sums = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        written.filter("_at = 0")
        .select("_bucket", "_n")
        .withColumn("_offset", F.coalesce(F.sum("_n").over(sums), F.lit(0)))
        .drop("_n")
    )
    # 16 bytes a bucket; the number of buckets is known here.
    if buckets <= BROADCAST_BUCKETS:
        offsets = F.broadcast(offsets)
    place = F.col("_offset") + F.col("_at")
    return (
        written.join(offsets, "_bucket")
        .withColumn("shard", F.pmod(place, F.lit(rule.shards)).cast("int"))
        .withColumn("slot", F.floor(place / rule.shards).cast("long"))
        .select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)], "shard", "slot")
    )


def write_shards(docs: DataFrame, folder: str, rule: ShardRule = ShardRule()) -> None:
    """Write the records of ``docs`` under ``folder``/shard=N, with their slots."""
    shuffle_records(docs, rule).write.partitionBy("shard").parquet(folder)
