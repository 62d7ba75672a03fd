"""Session helpers shared by queries, tests and the bench."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(cpus: int | str = "*", app: str = "tidemark", **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the session is given."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return reachable_by_workers(spark)


def reachable_by_workers(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it, whatever the working folder."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. A cluster must name it; a local master may use its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: name a folder that all machines share")
    return os.path.join(tempfile.gettempdir(), "tidemark-checkpoints")


def durable(df: DataFrame) -> DataFrame:
    """Cuts the lineage with checkpoint() in the shared folder named by spark.checkpoint.dir.

    The setting is read from the session; only where it is unset on a local master
    (tests) is a folder of our own used.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


BROADCAST_ROWS = 1_000_000  # rows of fixed width up to which a side is broadcast; 16 MB at 16 bytes a row


def bounded(df: DataFrame) -> DataFrame:
    """Rows of fixed width: broadcast while their number is within BROADCAST_ROWS, joined by shuffle beyond."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """More partitions before work that is heavy per row, where the scan gives fewer than there are cores.

    Large tables already come in enough partitions and are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * per_core) if df.rdd.getNumPartitions() < cores else df
