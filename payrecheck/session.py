"""Session helpers: a tuned local session and tables staged in shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
ADVISORY_CONF = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
PARTITIONS_CONF = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
#: Parts that an exchange is cut into where tasks are bounded; small neighbours are read by one task.
PARTS = 1000
#: The folder of a local application that names none, by its id; the setting itself is fixed
#: when a session starts.
_LOCAL: dict[str, str] = {}


def local_session(app: str = "payrecheck", cores: str = "*") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder staged tables go to.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session may
    fall back to a temporary folder: on a cluster other machines cannot read it.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError(
            f"set {CHECKPOINT_CONF} to a folder every executor can reach; "
            "staged tables must survive the loss of a machine."
        )
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="payrecheck-")
    return _LOCAL[context.applicationId]


def stage(df: DataFrame, name: str, task_bytes: str | None = None) -> DataFrame:
    """Write ``df`` to shared storage once and return the written table.

    Used where several later steps read the same rows.  A written Parquet table
    survives lost executors, cuts the lineage, lets each reader prune columns
    and gives the optimiser true sizes for its broadcast decisions.  ``task_bytes``: how much of
    an exchange a task of this job reads at most, in up to ``PARTS`` parts or the session's shuffle
    partitions, if these are more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/payrecheck/{name}-{uuid.uuid4().hex}"
    names = (ADVISORY_CONF, PARTITIONS_CONF)
    was = [spark.conf.get(n, None) for n in names]
    try:
        if task_bytes is not None:
            parts = max(PARTS, int(was[1] or spark.conf.get("spark.sql.shuffle.partitions")))
            for n, v in zip(names, (task_bytes, parts), strict=True):
                spark.conf.set(n, v)
        df.write.parquet(path)
    finally:
        for n, v in zip(names, was, strict=True):
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)
    return spark.read.schema(df.schema).parquet(path)
