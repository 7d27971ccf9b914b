"""Session-level helpers: durable cut points and size limits for broadcasts."""

from __future__ import annotations

import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

# A side is broadcast only when its counted rows stay below this bound.
BROADCAST_ROWS = 500_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; make one only for a local session."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", "")
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="oddlog-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")


# Narrow rows that one file of a checkpoint of known size should hold.
FILE_ROWS = 250_000


def freeze(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write ``df`` once to the checkpoint folder and read it from there on.

    Range exchanges pick their bounds from a sample, so whatever is derived
    from a partition number must not be evaluated twice. ``rows``, a bound on
    the rows of a narrow frame, keeps a small one from many tiny files.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return (df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))).checkpoint()


def hold(df: DataFrame) -> DataFrame:
    """Keep a reused frame in memory or on disk, in as many partitions as it needs."""
    df.sparkSession.conf.set("spark.sql.optimizer.canChangeCachedPlanOutputPartitioning", "true")
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def spread(df: DataFrame) -> DataFrame:
    """Share a table of few splits among all cores before costly row work.

    A large table has more splits than cores and stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def broadcast_if_small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast for a side whose row count is known to be small."""
    return F.broadcast(df) if rows <= limit else df
