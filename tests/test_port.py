"""The feature port: pushed filters, folders, byte ranges, missing signals, and the same rows from any DataFrame."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.sources import port


def Halves():
    class Own:  # of a function, so that it travels with what uses it
        name, feature_space, dim, columns = "halves", "half", 2, ("a", "b")

        def extract(self, frames):
            return np.stack([frames.column(c).cast("double").to_numpy().astype(float) / 2 for c in self.columns], 1)

    return Own()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("port") / "tubelets")
    rows = [(f"c {i % 3}/x", i % 7, "main" if i % 2 else None, i, float(i), None if i % 4 == 0 else float("nan") if i % 4 == 1 else float(-i), "junk") for i in range(600)]
    df = spark.createDataFrame([*rows, rows[5], (None, None, None, None, 1.0, 2.0, "x")], "clip_id string, track_id long, rider_role string, frame_idx long, a double, b double, features string")
    df.repartition(2).write.option("parquet.block.size", 2048).partitionBy("clip_id").parquet(root)
    return root, df


def plain(df):
    return sorted(((*r[:5], tuple(None if x is None else x for x in r[5])) for r in df.collect()), key=repr)


def test_rows_equal_those_of_the_frames(spark, stored):
    root, df = stored
    read = spark.read.format(port.register(spark, Halves())).load(root)
    got = plain(read)
    assert got == plain(port.extracted(df, Halves())) and len(got) == 602
    for clip, track, role, frame, space, v in got:
        assert space == "half" and len(v) == 2 and not any(x is not None and math.isnan(x) for x in v)
        if frame is not None:
            assert v == (frame / 2, None if frame % 4 < 2 else -frame / 2) and role == ("main" if frame % 2 else None)
    # ranges of a few bytes: each row group is read by one of them
    assert plain(spark.read.format("halves").option("range", 1000).load(root)) == got


@pytest.mark.parametrize("test", ["track_id = 3", "track_id in (1, 5, 90)", "frame_idx >= 590 and frame_idx < 595", "clip_id = 'c 1/x'", "clip_id is null", "clip_id is not null and rider_role = 'main'", "frame_idx > 10 and size(features) = 2 and features[1] < -300", "track_id <=> null", "frame_idx = 1 or track_id = 2", "not (track_id = 2)", "track_id <= 0", "clip_id in ('c 0/x', 'none')", "frame_idx > 5000"])
def test_filters(spark, stored, test):
    root, df = stored
    read = spark.read.format(port.register(spark, Halves())).load(root)
    assert plain(read.where(test)) == plain(port.extracted(df, Halves()).where(test))


def test_filters_are_pushed(stored):
    root, _ = stored
    names = {p: p for p in port._PLACES}
    reader = port._Reader(Halves(), root, names, port.RANGE)
    whole = len(reader.partitions())
    from pyspark.sql.datasource import EqualTo, StringContains

    other = StringContains(("clip_id",), "c")
    assert list(reader.pushFilters([EqualTo(("clip_id",), "c 1/x"), EqualTo(("frame_idx",), 7), EqualTo(("features",), 1), other])) == [EqualTo(("features",), 1), other]
    ranges = reader.partitions()
    assert 0 < len(ranges) < whole and {r.folders["clip_id"] for r in ranges} == {"c 1/x"}
    assert [b.column(3).to_pylist() for r in ranges for b in reader.read(r)] == [[7]]


def test_the_plan_shows_the_pushed_filter(spark, stored):
    root, _ = stored
    df = spark.read.format(port.register(spark, Halves())).load(root).where("track_id = 3")
    plan = df._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "Scan" in line]
    assert len(scans) == 1 and "Filter (" not in plan, plan
    assert not any("= 3" in line for line in plan.splitlines()), plan  # nothing is left for Spark to test


def test_wrong_widths_lost_columns_and_empty_tables(spark, stored, tmp_path):
    root, df = stored
    bad = Halves()
    bad.dim = 3
    with pytest.raises(Exception, match="3 wide"):
        port.extracted(df, bad).collect()
    lost = port.ColumnExtractor("lost", "x", ["nothing"])
    with pytest.raises(Exception, match="nothing"):
        port.extracted(df, lost).collect()
    with pytest.raises(ValueError, match="places"):
        port.register(spark, port.ColumnExtractor("own", "x", ["frame_idx"]))
    df.limit(0).write.parquet(str(tmp_path / "none"))
    assert spark.read.format(port.register(spark, Halves())).load(str(tmp_path / "none")).collect() == []
    assert port.extracted(df.limit(0), Halves()).collect() == []
    with pytest.raises(Exception, match="missing-here"):
        spark.read.format("halves").load(str(tmp_path / "missing-here")).collect()


def test_columns_by_option(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(50).select((F.col("id") % 3).cast("int").alias("k"), F.col("id").alias("n"), F.col("id").cast("string").alias("c"), (F.col("id") * 2).alias("x")).write.parquet(path)
    name = port.register(spark, port.ColumnExtractor("stored_x", "x", ["x"]))
    got = spark.read.format(name).option("clip", "c").option("track", "k").option("frame", "n").load(path).where("track_id = 1").orderBy("frame_idx").collect()
    assert [(r.clip_id, r.track_id, r.rider_role, r.frame_idx, r.features) for r in got] == [(str(i), 1, None, i, [2.0 * i]) for i in range(50) if i % 3 == 1]
