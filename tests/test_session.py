import pytest
from pyspark.sql import functions as F

from payrecheck import session


class _Conf:
    def __init__(self, named):
        self.named = named

    def get(self, key, default=None):
        return self.named or default


class _Session:
    """A session whose settings name a folder, or none."""

    def __init__(self, spark, named=None, master="local[2]"):
        self.conf = _Conf(named)
        context = type("Context", (), {"master": master, "applicationId": "app-1"})
        self.sparkContext = context


def test_a_local_session_without_a_folder_gets_one_of_its_own(spark):
    first = session.shared_dir(_Session(spark))
    assert first == session.shared_dir(_Session(spark))
    df = spark.range(3)
    path = f"{first}/written"
    df.write.parquet(path)
    assert spark.read.parquet(path).count() == 3


def test_the_named_folder_is_used_and_a_cluster_must_name_one(spark):
    assert session.shared_dir(_Session(spark, "/named/")) == "/named"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(_Session(spark, master="yarn"))


def test_stage_returns_the_written_rows(spark):
    staged = session.stage(spark.range(5), "numbers")
    assert staged.count() == 5 and "parquet" in staged._jdf.queryExecution().toString().lower()


def test_tasks_of_a_bounded_stage_do_not_grow_with_few_shuffle_partitions(spark, tmp_path):
    def most_rows(task_bytes):
        rows = spark.range(200_000).select((F.col("id") * 7919).alias("k"), F.uuid().alias("v"))
        counted = rows.groupBy("k").agg(F.max("v").alias("v"))
        staged = session.stage(counted.withColumn("p", F.spark_partition_id()), "bounded", task_bytes)
        return staged.groupBy("p").count().agg(F.max("count")).first()[0]

    names = (session.ADVISORY_CONF, session.PARTITIONS_CONF, "spark.sql.shuffle.partitions")
    least = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    was = [spark.conf.get(n, None) for n in names]
    spark.conf.set(least, "64k")
    try:
        assert most_rows(None) > 40_000
        assert most_rows("256k") < 20_000
    finally:
        spark.conf.unset(least)
    assert [spark.conf.get(n, None) for n in names] == was
