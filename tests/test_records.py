"""Sources side by side, the workbench table, likeness records, segment pairs, published versions."""

import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators.alignment import aligned, assembled
from tracewell.plans import evals, workbench
from tracewell.plans.likeness import likeness_records
from tracewell.sources import published


def test_aligned(spark):
    a = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (None, 3, "z"), (1, 1, "w")], "t long, f long, v string")
    b = spark.createDataFrame([(1, 1, 2.5, [1.0]), (2, 9, 0.5, None)], "t long, f long, v double, e array<double>")
    c = spark.createDataFrame([], "t long, f long, n int")
    found = {(r["t"], r["f"]): r for r in aligned({"a": a, "b": b, "c": c}, ["t", "f"]).collect()}
    assert set(found) == {(1, 1), (1, 2), (None, 3), (2, 9)}
    assert found[1, 1]["a"]["v"] == "x" and found[1, 1]["b"]["e"] == [1.0] and found[1, 2]["b"] is None and found[2, 9]["a"] is None and found[1, 1]["c"] is None
    based = aligned({"a": a, "b": b, "c": c}, ["t", "f"], "a")
    assert based.count() == 3
    assert based._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_assembled_without_a_lane(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "t long, v string")
    b = spark.createDataFrame([(1, 2.5), (3, 1.0)], "t long, w double")
    found = {r["t"]: r for r in assembled({"a": a, "gone": None, "b": b}, ["t"], "a").collect()}
    assert set(found) == {1, 2} and found[1]["b"]["w"] == 2.5 and found[2]["b"] is None and found[1]["gone"] is None
    assert list(found[1].asDict()) == ["t", "a", "gone", "b"]


def _workbench(spark, valid):
    at = "clip_id long, track_id long, frame_idx long"
    frames = [(1, 7, i) for i in range(12)] + [(1, 8, i) for i in range(12)]
    riders = spark.createDataFrame([(1, 7, "main"), (1, 7, "main"), (1, 8, "guest")], "clip_id long, track_id long, role string")
    landmarks = spark.createDataFrame([(*k, k[2] / 20, 0.5, 0.1) for k in frames], f"{at}, expr double, pupil double, sym double")
    gate = spark.createDataFrame([(*k, k[2] in valid) for k in frames if k[2] != 3], f"{at}, valid boolean")
    features = spark.createDataFrame([(*k, 1.0, float(k[2])) for k in frames], f"{at}, yaw double, blur double")
    parse = spark.createDataFrame([(*k, 4.0, 0.01, 0.8, 0.25) for k in frames if k[2] % 2], f"{at}, micro double, mv double, lum double, chi double")
    detections = spark.createDataFrame([(*k, [3.0, 4.0] if k[2] else None) for k in frames], f"{at}, embedding array<double>")
    tubelets = spark.createDataFrame([(*k, "boarding") for k in frames if k[2] < 4], f"{at}, scene_phase string")
    return workbench.main_rider_frames(riders, landmarks, gate, features, parse, detections, tubelets)


def test_main_rider_frames(spark):
    found = {r["frame_idx"]: r for r in _workbench(spark, set(range(11))).collect()}
    assert set(found) == set(range(11)) - {3} and {r["track_id"] for r in found.values()} == {7}
    assert abs(found[1]["lum_eff"] - 0.6) < 1e-12 and found[2]["lum_eff"] is None and found[2]["micro"] is None
    assert found[1]["board"] and not found[5]["board"] and found[0]["size"] is None and abs(found[5]["coherence"] - 1) < 1e-12 and found[5]["size"] == 5.0
    assert len(_workbench(spark, {1, 2}).collect()) == 12  # too few are valid


def test_picks_keep_their_distance(spark):
    wide = _workbench(spark, set(range(12)))
    got = workbench.picked(wide, ["clip_id", "track_id"], "frame_idx", {"expr": (None, 0.5)}, {"face": 1.0}, gap=4).orderBy("pick").collect()
    assert [r["frame_idx"] for r in got] == [0, 4, 8] and [r["pick"] for r in got] == [1, 2, 3]


def test_likeness_without_a_blend(spark):
    rng = random.Random(3)
    rows = [(t, i, [rng.random() for _ in range(6)], i % 3 == 0, rng.random(), "left" if i % 2 else None, rng.random()) for t in (1, 2) for i in range(14)]
    own = spark.createDataFrame(rows, "t long, f long, shape array<double>, calm boolean, yaw double, view string, score double")
    record = likeness_records(own, ["t"], "f", "shape", None, [], ["yaw"], gap=3).where("t = 1").first()
    assert record["neutral"] is None and record["expression"] is None and record["shape"]["n"] == 14 and len(record["components"]["axes"]) == 3
    frames = record["samples"]["frames"]
    assert len(frames) == 3 and all(abs(a - b) >= 3 for a in frames for b in frames if a != b)
    assert [v["view"] for v in record["views"]["found"]] == ["left"] and len(record["axes"]["found"]) == 3
    assert likeness_records(own.limit(0), ["t"], "f", "shape", None, [], ["yaw"]).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_random_windows_are_free_and_reach_every_start(spark, seed):
    rng = random.Random(seed)
    spans = [(t, r, s, s + rng.randint(2, 9)) for t in range(40) for r, s in enumerate((rng.randint(0, 40) for _ in range(3)), 1)]
    ranges = [(t, 3, rng.randint(5, 70)) for t in range(40)]
    df = spark.createDataFrame(spans, "t long, rank int, start long, end long")
    wanted = df.where("rank <= 2")
    lims = spark.createDataFrame(ranges, "t long, lo long, hi long")
    found = {(r["t"], r["rank"]): r["at"] for r in evals.random_windows(wanted, df, lims, ["t"], seed).collect()}
    for t, lo, hi in ranges:
        own = [(a, b) for x, _, a, b in spans if x == t]
        for rank in (1, 2):
            n = own[rank - 1][1] - own[rank - 1][0]
            free = [s for s in range(lo, hi - n) if all(s + n < a or s > b for a, b in own)]
            assert ((t, rank) in found) == bool(free) and (not free or found[t, rank] in free)
    again = {(r["t"], r["rank"]): r["at"] for r in evals.random_windows(wanted.repartition(5), df, lims, ["t"], seed).collect()}
    assert again == found and (len(spans) == 0 or len(set(found.values())) > 10)


def test_published_versions(spark, tmp_path, monkeypatch):
    path, kind = f"file://{tmp_path}/likeness", "t long, record struct<n: long, list: array<double>>"
    first = spark.createDataFrame([(1, (3, [1.0, 2.0])), (2, None)], kind)
    assert published.read_published(spark, path, kind, "json").collect() == []
    assert published.publish(first, path, "json") == 1
    assert sorted(published.read_published(spark, path, kind, "json").collect()) == sorted(first.collect())

    @F.udf("long")
    def broken(x):
        raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):  # a write that dies while its data are written
        published.publish(first.withColumn("t", broken("t")), path, "json")
    first.write.json(f"{path}/data/000000000002-left")  # and one that dies before its commit
    assert published.version(spark, path) == 1 and published.read_published(spark, path, kind, "json").count() == 2
    (tmp_path / "likeness/versions/000000000002").write_text("000000000002-le")  # and one whose commit is not whole
    assert published.version(spark, path) == 1
    (tmp_path / "likeness/versions/000000000002").unlink()

    own = published.read_published(spark, path, kind, "json")
    assert published.publish(own.where("t = 1"), path, "json", after=1) == 2  # made from the version that it replaces
    with pytest.raises(published.Conflict):
        published.publish(first, path, "json", after=1)
    assert [r["t"] for r in published.read_published(spark, path, kind, "json").collect()] == [1]
    for _ in range(3):
        published.publish(first, path, "json")
    assert len(list((tmp_path / "likeness/versions").glob("0*"))) == 2 and published.version(spark, path) == 5
