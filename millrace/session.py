"""Session helpers: one builder for local work, and settings every operator relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build(app: str = "millrace", cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; a cluster passes its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
        .getOrCreate()
    )


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, for checkpoints and intermediate tables.

    It is the cluster's own (``spark.checkpoint.dir``). Only where that is unset,
    and the master is local, a temporary folder is taken.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if at is None:
            if not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            at = tempfile.mkdtemp(prefix="millrace-checkpoint-")
        sc.setCheckpointDir(at)
    return sc._jsc.sc().getCheckpointDir().get()


def _path(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, removed when the application ends."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    path, fs = _path(spark, at)
    fs.deleteOnExit(path)
    return at


def remove(spark: SparkSession, at: str) -> None:
    path, fs = _path(spark, at)
    fs.delete(path, True)


def stamp(spark: SparkSession, at: str) -> tuple[int, int]:
    """(modification time, bytes) of a file or folder: tells whether a table has changed."""
    path, fs = _path(spark, at)
    return fs.getFileStatus(path).getModificationTime(), fs.getContentSummary(path).getLength()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df``: it is written as a table to the shared folder, once, and read again."""
    at = scratch(df.sparkSession, "cut")
    df.write.parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out._millrace_at = at
    return out


def forget(df: DataFrame) -> None:
    """Remove the table of a :func:`checkpointed` frame that nothing reads any more."""
    remove(df.sparkSession, df._millrace_at)


def data_dir(default: str = "/root/testdata/sf0.001") -> str:
    return os.environ.get("MILLRACE_DATA", default)
