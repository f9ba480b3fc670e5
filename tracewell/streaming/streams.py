"""Streams of observations: windows, sessions, duplicates, mergeable state.

Each function takes a streaming (or batch) DataFrame and returns one, so sources and sinks stay the caller's.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracewell.sources.checkpoints import removed


def timed(rows: DataFrame, time: str, late: str) -> DataFrame:
    """The time column as a timestamp with a watermark."""
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def beats(rows: DataFrame, time: str, keys: list[str], every: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """Counts and means for each tumbling window."""
    return timed(rows, time, late).groupBy(F.window(time, every).alias("w"), *keys).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def sliding(rows: DataFrame, time: str, keys: list[str], length: str, step: str, late: str = "1 minute") -> DataFrame:
    return timed(rows, time, late).groupBy(F.window(time, length, step).alias("w"), *keys).agg(F.count("*").alias("n"), F.max("value").alias("peak"))


def sessions(rows: DataFrame, time: str, keys: list[str], gap: str = "2 seconds", late: str = "1 minute") -> DataFrame:
    """Runs of observations without a gap of `gap`."""
    return timed(rows, time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def accepted_once(jobs: DataFrame, time: str, key: str, late: str = "1 hour") -> DataFrame:
    """Jobs without those whose key was accepted before, within the watermark."""
    return timed(jobs, time, late).dropDuplicatesWithinWatermark([key])


def running_distribution(rows: DataFrame, key: str, x: str) -> DataFrame:
    """key, n, mean, m2 after each batch: the summary is the state, merged with each batch's own."""
    kind = rows.schema[key].dataType.simpleString()

    def merge(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean, m2 = state.get if state.exists else (0, 0.0, 0.0)
        for batch in batches:
            v = batch[x].dropna()
            if len(v):
                more, own = len(v), float(v.mean())
                m2 += float(((v - own) ** 2).sum()) + (own - mean) ** 2 * n * more / (n + more)
                mean += (own - mean) * more / (n + more)
                n += more
        state.update((n, mean, m2))
        yield pd.DataFrame({key: [k[0]], "n": [n], "mean": [mean], "m2": [m2]})

    return rows.select(key, x).groupBy(key).applyInPandasWithState(merge, f"{key} {kind}, n long, mean double, m2 double", "n long, mean double, m2 double", "update", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, keys: list[str], folder: str, mode: str = "update") -> DataFrame:
    """Run a stream over all there is and return its last state of each key.

    Batches are written as they come, under their number (a repeated batch overwrites itself); of each key the row of the last batch counts.
    """
    spark: SparkSession = stream.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    removed(spark, f"{folder}/state")
    rows = spark.read.parquet(f"{folder}/rows").drop("batch")
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__batch")))
    return rows.withColumn("__n", last).where("__n = 1").drop("__n", "__batch")
