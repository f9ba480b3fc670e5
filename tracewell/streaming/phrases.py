"""Phrases of a stream: runs of a key's observations without a gap, kept as state of their own and closed by timers; rows that come too late go to a side output."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracewell.sources.checkpoints import removed

_STORE = "spark.sql.streaming.stateStore.providerClass"
#: The store that this kind of state needs (a fixed value).
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Phrases(StatefulProcessor):
    """State of a key: its open phrases (first, last, n, total). A row joins those it is within `gap` of, several become one. A phrase whose end is `gap` before the watermark can't grow any
    more: a timer hands it on and forgets it, so state is what is open, whatever the stream's length. A key has one timer, that of its earliest phrase, and sets the next when it is called, so a
    jump of the watermark calls a key once, not once a phrase."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "first long, last long, n long, total double")

    def _rows(self, key: tuple, kind: str, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["first", "last", "n", "total"])
        out.insert(0, "key", key[0])
        out.insert(0, "kind", kind)
        return out

    def _kept(self, phrases: list[tuple]) -> None:
        """Phrases in order are put, with a timer for the first to end."""
        self.open.put(phrases)
        self.handle.registerTimer((phrases[0][1] + self.gap) // 1000 + 1)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, bound = [tuple(x) for x in self.open.get()], timerValues.getCurrentWatermarkInMs()
        late: list[tuple] = []
        for batch in rows:
            for at, x in zip(batch["at"].tolist(), batch["x"].tolist()):
                one = (int(at), int(at), 1, 0.0 if x is None or x != x else float(x))
                (late if at < bound * 1000 else held).append(one)
        held.sort()
        joined: list[tuple] = []
        for first, last, n, total in held:
            if joined and first - joined[-1][1] < self.gap:
                a, b, m, s = joined[-1]
                joined[-1] = (a, max(b, last), m + n, s + total)
            else:
                joined.append((first, last, n, total))
        if joined:
            self._kept(joined)
        if late:
            yield self._rows(key, "late", late)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, bound = [tuple(x) for x in self.open.get()], timerValues.getCurrentWatermarkInMs() * 1000
        done = [p for p in held if p[1] + self.gap <= bound]
        if done:
            left = [p for p in held if p[1] + self.gap > bound]
            if left:
                self._kept(left)
            else:
                self.open.clear()
            yield self._rows(key, "phrase", done)

    def close(self) -> None:
        pass


def phrases(rows: DataFrame, time: str, key: str, x: str, gap: int, late: str = "1 minute") -> DataFrame:
    """kind, key, first, last, n, total: "phrase" rows, runs of a key's rows less than `gap` apart, once the watermark (`late` behind the newest row) has passed their end by the gap, and
    "late" rows, one for each observation that came behind the watermark; those join no phrase. Times and gap are in microseconds; a null value counts as 0 in the total, a row without a time is
    passed over. rows is a stream; null keys are a key."""
    # keys travel as texts that are never null: pandas takes null numbers for NaN, which equals no key
    own = rows.select(F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")).alias("key"), F.col(time).cast("timestamp").alias("__t"), F.col(x).cast("double").alias("x")).where("__t is not null").withWatermark("__t", late)
    # the engine itself drops late rows by the watermarked column, so what goes on is the plain time
    plain = own.select("key", F.unix_micros("__t").alias("at"), "x")
    found = plain.groupBy("key").transformWithStateInPandas(Phrases(gap), "kind string, key string, first long, last long, n long, total double", "Append", "EventTime")
    return found.withColumn("key", F.when(F.col("key") != "", F.substring("key", 2, 1 << 30)).cast(rows.schema[key].dataType))


def drained_phrases(stream: DataFrame, folder: str) -> DataFrame:
    """Run phrases() over all there is and return what it has handed on. Rows are written under the number of their batch, so a repeated batch overwrites itself.
    The session's state store is set for the run and put back after it."""
    spark = stream.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        stream.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_STORE, before)
    removed(spark, f"{folder}/state")
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
