"""Session settings and the durable folder used to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that matter for the plans in this package.  They are all ordinary
# Spark settings; a cluster may override any of them.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A session for tests and the bench; on a cluster use the one you are given."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gradeflow")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in {**DEFAULT_CONF, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Temporary folder of each local application without a configured one.
_LOCAL: dict[str, str] = {}


def durable_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session,
    where every task runs on this machine, may fall back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):  # local-cluster has executors of its own
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL:
        _LOCAL[application] = tempfile.mkdtemp(prefix="gradeflow-")
    return _LOCAL[application]


def new_work_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the durable folder."""
    return f"{durable_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def freeze(df: DataFrame, name: str = "frozen") -> DataFrame:
    """Write ``df`` once to the durable folder and go on from the copy.

    Needed where rows get an attribute that a recomputation could assign
    differently (range boundaries, partition ids) and that is then read twice.
    The copy is a columnar table: it is written in one pass, outlives lost
    executors, and later reads take only the columns they use.
    """
    path = new_work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
