import random

from pyspark.sql import functions as F

from payrecheck.operators.ranks import with_rank


def _plain(rows):
    """(group, value) rows with rank, size and rank of the group."""
    groups = sorted({g for g, _ in rows}, key=lambda g: (g is not None, g or ""))
    out = []
    for k, g in enumerate(groups):
        mine = sorted((v for h, v in rows if h == g), reverse=True)
        out += [(g, v, i, len(mine), k) for i, v in enumerate(mine)]
    return sorted(out, key=str)


def test_ranks_equal_a_plain_sort(spark):
    rng = random.Random(1)
    names = ["hot"] * 10 + ["a", "b", None, "", "é", "zz"]
    rows = [(rng.choice(names), v) for v in range(700)] + [(f"g{k}", k) for k in range(60)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(5)
    got = with_rank(df, [F.col("v").desc()], ["g"], "r", size="n", group="k")
    assert got.columns == ["g", "v", "r", "n", "k"]
    assert sorted(map(tuple, got.collect()), key=str) == _plain(rows)


def test_one_order_over_all_rows(spark):
    rows = [(v * 7919 % 1009,) for v in range(1009)]
    got = with_rank(spark.createDataFrame(rows, "v int"), [F.col("v")], rank="at").collect()
    assert all(r.at == r.v for r in got) and len(got) == 1009


def test_no_rows_and_equal_rows(spark):
    none = spark.createDataFrame([], "g string, v int")
    assert with_rank(none, [F.col("v")], ["g"], size="n", group="k").collect() == []
    same = spark.createDataFrame([("a", 1)] * 6, "g string, v int")
    assert sorted(r["rank"] for r in with_rank(same, [F.col("v")], ["g"]).collect()) == [*range(6)]


def test_no_window_over_all_rows(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    plan = with_rank(df, [F.col("id")], ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
