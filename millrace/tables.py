"""Reading the named tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, where: str, name: str) -> DataFrame:
    """Table ``name`` below ``where`` as parquet; column pruning reaches the scan."""
    return spark.read.parquet(f"{where}/{name}.parquet")


def bounded(df: DataFrame, limit: int, what: str) -> list:
    """Collect a table that must be small, and refuse it when it is not.

    Used before anything is shipped to every task: the size is checked, never assumed.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows and can't be shipped to every task")
    return rows


def once_per_id(df: DataFrame, *keys: str) -> DataFrame:
    """Rows repeated under one key count once: identical copies collapse to one row."""
    return df.dropDuplicates(list(keys))


def month(ts):
    """Calendar month of a timestamp as ``yyyy-MM`` (session time zone)."""
    return F.date_format(ts, "yyyy-MM")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, before work that is heavy per row.

    Only a plain scan that gives fewer partitions is dealt out, so a large table
    is never shuffled for it. Results don't depend on it.
    """
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
