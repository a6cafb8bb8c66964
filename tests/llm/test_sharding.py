"""Laws of the sharding: every record once, counts, slots, and a uniform order."""

from collections import Counter

from payrecheck.llm.sharding import ShardRule, shuffle_records, write_shards
from payrecheck.session import shared_dir, stage

KIND = "doc_id long, text string, shard string, record int"


def rows(n):
    texts = ["", None, "same", "a longer text é", "x" * 2000]
    return [(None if k % 50 == 0 else k // 2, texts[k % 5], "s", k) for k in range(n)]


def test_every_record_once_counts_and_slots(spark):
    docs = stage(spark.createDataFrame(rows(1003), KIND), "records")
    got = shuffle_records(docs, ShardRule(bucket_bytes=20_000))
    assert got.columns == ["doc_id", "text", "shard", "record", "shard", "slot"]
    out = [tuple(r) for r in got.collect()]
    assert sorted(map(repr, (r[:4] for r in out))) == sorted(map(repr, rows(1003)))
    counts = Counter(r[4] for r in out)
    assert sorted(counts) == list(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    for shard, n in counts.items():
        assert sorted(r[5] for r in out if r[4] == shard) == list(range(n))
    again = [tuple(r) for r in shuffle_records(docs, ShardRule(bucket_bytes=20_000)).collect()]
    assert sorted(map(repr, again)) == sorted(map(repr, out))
    other = [tuple(r) for r in shuffle_records(docs, ShardRule(seed=5)).collect()]
    assert sorted(map(repr, other)) != sorted(map(repr, out))


def test_order_is_uniform(spark):
    docs = stage(spark.range(16000).toDF("doc_id").selectExpr("doc_id", "'x' AS text"), "range")
    got = shuffle_records(docs, ShardRule(shards=4, bucket_bytes=200_000)).collect()
    place = {r.doc_id: r.slot * 4 + r.shard for r in got}
    # Quarters of the input against quarters of the output: 1000 expected in each of 16.
    cells = Counter((d // 4000, p // 4000) for d, p in place.items())
    assert sum((n - 1000) ** 2 / 1000 for n in cells.values()) < 40
    apart = sum(abs(place[d] - place[d + 1]) < 4 for d in range(15999))
    assert apart < 30


def test_repeated_rows_spread_and_no_rows(spark):
    same = stage(spark.createDataFrame([(7, "same", "s", 1)] * 4000, KIND), "same")
    got = shuffle_records(same, ShardRule(bucket_bytes=16_000))
    assert Counter(r[4] for r in got.collect()) == {k: 250 for k in range(16)}
    assert shuffle_records(stage(spark.createDataFrame([], KIND), "none")).collect() == []


def test_shards_are_written(spark):
    docs = stage(spark.range(100).selectExpr("id AS doc_id", "'t' AS text"), "few")
    folder = f"{shared_dir(spark)}/shards-test-{id(docs)}"
    write_shards(docs, folder, ShardRule(shards=3))
    back = spark.read.parquet(folder)
    assert {r.shard: r["count"] for r in back.groupBy("shard").count().collect()} == {0: 34, 1: 33, 2: 33}


def test_one_order_however_the_files_are_cut(spark, tmp_path):
    """More cores, or other splits, change neither shard nor slot."""
    path = str(tmp_path / "records")
    docs = spark.createDataFrame(rows(3000), KIND).drop("shard")
    docs.coalesce(2).write.option("parquet.block.size", 4096).parquet(path)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    was = [spark.conf.get(n) for n in names]
    found = []
    try:
        for size in ("64m", "4k"):
            for n, v in zip(names, (size, "1"), strict=True):
                spark.conf.set(n, v)
            table = spark.read.parquet(path)
            found.append((table.rdd.getNumPartitions(), sorted(map(repr, shuffle_records(table).collect()))))
    finally:
        for n, v in zip(names, was, strict=True):
            spark.conf.set(n, v)
    assert found[0][0] != found[1][0]
    assert found[0][1] == found[1][1]


def test_equals_a_plain_two_pass_shuffle_up_to_the_order_in_buckets(spark, tmp_path):
    """The same records in the same buckets, buckets one after the other."""
    from pyspark.sql import functions as F

    path = str(tmp_path / "records")
    spark.range(2000).selectExpr("id AS doc_id", "repeat('y', 100) AS text").coalesce(1).write.parquet(path)
    table, rule = spark.read.parquet(path), ShardRule(shards=3, bucket_bytes=20_000)
    placed = table.select("doc_id", F.xxhash64(F.lit(rule.seed), "_metadata.file_name", "_metadata.row_index").alias("p"))
    hashes = {r.doc_id: r.p for r in placed.collect()}
    total = 2000 * 164
    buckets = max(1, -(-total // 20_000), min(64, total // 4096))
    plain = {}
    for doc, h in hashes.items():
        plain.setdefault(h % buckets, set()).add(doc)
    order = {r.slot * 3 + r.shard: r.doc_id for r in shuffle_records(table, rule).collect()}
    at = 0
    for bucket in sorted(plain):
        n = len(plain[bucket])
        assert {order[k] for k in range(at, at + n)} == plain[bucket]
        at += n
    assert at == 2000
