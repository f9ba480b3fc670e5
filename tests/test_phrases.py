"""Phrases of a stream, with rows that come late."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from tracewell.streaming.phrases import Phrases, drained_phrases, phrases

T0 = dt.datetime(2024, 1, 1)


def test_phrases_with_late_rows(spark, tmp_path):
    def put(number, rows):
        data = spark.createDataFrame([(k, T0 + dt.timedelta(seconds=s), v) for k, s, v in rows], "k string, ts timestamp, v double")
        data.coalesce(1).write.parquet(f"{tmp_path}/in/{number}")

    put(1, [("a", 0, 1.0), ("a", 1, 2.0), ("a", 5, 4.0), ("b", 0, 1.0), (None, 3, 1.0)])
    put(2, [("a", 3, 8.0), ("a", 4, None), ("b", 100, 1.0), ("b", None or 101, 1.0)])  # joins both phrases of a
    put(3, [("a", 2, 16.0), ("b", 102, 1.0)])  # far behind the watermark
    put(4, [("end", 1000, 0.0)])
    stream = spark.readStream.schema("k string, ts timestamp, v double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    found = drained_phrases(phrases(stream, "ts", "k", "v", 2_000_000, "10 seconds"), str(tmp_path / "out")).collect()
    start = int(T0.replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000)
    got = sorted((r["kind"], r["key"] or "", (r["first"] - start) // 1_000_000, (r["last"] - start) // 1_000_000, r["n"], r["total"]) for r in found)
    assert got == [("late", "a", 2, 2, 1, 16.0), ("phrase", "", 3, 3, 1, 1.0), ("phrase", "a", 0, 1, 2, 3.0), ("phrase", "a", 3, 5, 3, 12.0), ("phrase", "b", 0, 0, 1, 1.0), ("phrase", "b", 100, 102, 3, 3.0)]


def test_one_timer_a_key():
    class State:
        def __init__(self):
            self.held, self.timers = [], []

        def get(self):
            return iter(self.held)

        def put(self, rows):
            self.held = list(rows)

        def clear(self):
            self.held = []

        def registerTimer(self, at):
            self.timers.append(at)

    class Clock:
        def __init__(self, at):
            self.at = at

        def getCurrentWatermarkInMs(self):
            return self.at

    own, state = Phrases(1_000_000), State()
    own.open, own.handle = state, state
    assert list(own.handleInputRows(("k",), iter([pd.DataFrame({"at": [i * 10_000_000 for i in range(50)], "x": [1.0] * 50})]), Clock(0))) == []
    assert state.timers == [1001]  # of 50 phrases
    first = list(own.handleExpiredTimer(("k",), Clock(20_000), None))
    assert [len(x) for x in first] == [2] and state.timers == [1001, 21001]
    assert [len(x) for x in own.handleExpiredTimer(("k",), Clock(10_000_000), None)] == [48] and state.held == []
