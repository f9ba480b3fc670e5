"""Windowed tables are dealt over as many partitions as their rows need, whatever the session says."""

import os

import pytest

from tracewell.operators import joins as J
from tracewell.queries import book

SF = "/root/testdata/sf0.001"


def test_parts_of(spark):
    assert [book.parts_of(spark.range(n)) for n in (0, 5, 25_000, 1_000_001)] == [1, 1, 3, 6]


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name,make", [("lineitem", book.signals), ("events", book.frames)])
def test_tracks_are_dealt_by_rows(spark, monkeypatch, name, make):
    monkeypatch.setattr(book, "MOST", 100)
    made = make(spark, SF)
    assert made.rdd.getNumPartitions() == -(-book.table(spark, SF, name).count() // 100)
    assert "REPARTITION_BY_NUM" in made._jdf.queryExecution().executedPlan().toString()


def test_strict_alignment_is_dealt(spark):
    base = spark.createDataFrame([(t, f) for t in range(30) for f in range(3)], "t long, f long")
    other = spark.createDataFrame([(t, f, t * 1.0) for t in range(30) for f in range(3) if t % 5 or f], "t long, f long, v double")
    out = J.strictly_aligned(base, other, ["t"], "f", 7)
    assert out.rdd.getNumPartitions() == 7 and {(r["t"], r["f"]): r["v"] for r in out.collect()} == {(t, f): t * 1.0 if t % 5 else None for t in range(30) for f in range(3)}
