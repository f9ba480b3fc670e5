"""Cutting lineage in loops, and folders that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_held: dict[str, SparkSession] = {}


def shared(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; only local sessions without one get a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/tracewell-scratch"


def removed(spark: SparkSession, folder: str) -> None:
    """Delete a folder, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _remove_all() -> None:
    for folder, spark in _held.items():
        try:
            if spark.sparkContext._jsc is not None:
                removed(spark, folder)
        except Exception:  # the JVM may have gone first
            pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, removed when the driver ends."""
    top = f"{shared(spark)}/scratch-{spark.sparkContext.applicationId}"
    _held[top] = spark
    return f"{top}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed to the folder named in spark.checkpoint.dir; only local sessions without one get a temporary folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch(spark, "checkpoints"))
    return df.checkpoint()
