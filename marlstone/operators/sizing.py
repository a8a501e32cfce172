"""Broadcasts behind a check of size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side is broadcast without asking the planner.
BROADCAST_ROWS = 100_000
#: Rows per Arrow batch: bounds a Python worker's memory when texts are long.
BATCH_ROWS = 256


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads at most one more."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it is small, else as it is, for a shuffled join."""
    return F.broadcast(df) if is_small(df, rows) else df


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the Arrow batches that Python workers hold.

    The planner reads this setting when a plan is run, not when it is made, so it stays
    set for the session; a smaller value that a session has is kept.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "0")) <= rows:
        spark.conf.set(key, str(rows))


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if its files make fewer splits than there are cores; large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
