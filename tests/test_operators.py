"""Operators on small cases with known answers, and against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.functions import numbers as N
from tracewell.functions import text as X
from tracewell.functions.vectors import mean_vector
from tracewell.operators import aggregates as A
from tracewell.operators import joins as J
from tracewell.operators import centres, kernels, moments
from tracewell.sources.published import read_published
from tracewell.operators import selection as K
from tracewell.operators import windows as W
from tracewell.operators.rules import Rule, evaluated, unresolved
from tracewell.plans import catalog, evals, gates, presets, readings, scores, subjects
from tracewell.sources import schemas, tables
from tracewell.streaming import streams


def value(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def track(spark, values, names="x double"):
    return spark.createDataFrame([(1, i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], f"t long, f long, {names}")


def column(df, name, order="f"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_percentile_and_unit_ranks(spark):
    rank = lambda v: column(track(spark, v).withColumn("p", W.percentile_rank(F.col("x"), ["t"])), "p")
    assert rank([1.0, 2.0, 3.0, 4.0]) == [25, 50, 75, 100]
    assert rank([1.0, None, 3.0]) == [50, None, 100]
    own = track(spark, [10.0, 20.0, 30.0])
    assert column(own.withColumn("r", W.unit_rank(F.col("x"), ["t"], "f")), "r") == [0, 0.5, 1]
    assert column(own.withColumn("r", W.unit_rank(F.col("x"), ["t"], "f", flip=True)), "r") == [1, 0.5, 0]


def test_state_blends(spark):
    made = scores.state_blends([F.lit(x) for x in (0.9, 0.6, 0.4, 0.8, 0.3, 0.5, 0.7, 1.0)])
    row = spark.range(1).select(*[v.alias(k) for k, v in made.items()]).first()
    assert [round(row[k], 9) for k in ("face", "light", "image", "distortion")] == [0.8, 1.0, 0.6, 0.5]


def test_balanced_pair(spark):
    assert value(spark, N.balanced_pair(F.lit(0.4), F.lit(0.6))) == 0.5
    assert value(spark, N.balanced_pair(F.lit(0.55), F.lit(1.15))) == 0.55


def test_bands_and_screens(spark):
    rows = spark.createDataFrame([(0, 0.0), (1, 70.0), (2, None)], "f long, yaw double")
    assert [r["f"] for r in rows.where(N.passes({"yaw": (60, 90)})).collect()] == [1, 2]
    assert value(spark, N.in_arc(F.lit(350.0), 300, 20)) and not value(spark, N.in_arc(F.lit(100.0), 300, 20))


def test_views_and_fusion(spark):
    view = lambda a, b: value(spark, N.view_class(F.lit(a).cast("double"), F.lit(b).cast("double")))
    assert [view(0, 10), view(None, 60), view(40, 60), view(-40, 60), view(10, 60), view(30, None), view(None, None)] == ["frontal", "side", "side", "angle", "frontal", "angle", None]
    picked, source = N.fused([F.lit(None).cast("double"), F.lit(1.0)], [F.lit(5.0), F.lit(None).cast("double")])
    assert value(spark, F.struct(*[p.alias(f"p{i}") for i, p in enumerate(picked)], source.alias("s"))).asDict() == {"p0": 5.0, "p1": None, "s": "second"}


def test_euler_of_a_rotation(spark):
    yaw, pitch = math.radians(30), math.radians(-20)
    ry = np.array([[math.cos(yaw), 0, math.sin(yaw)], [0, 1, 0], [-math.sin(yaw), 0, math.cos(yaw)]])
    rx = np.array([[1, 0, 0], [0, math.cos(pitch), -math.sin(pitch)], [0, math.sin(pitch), math.cos(pitch)]])
    m = np.eye(4)
    m[:3, :3] = ry @ rx
    found = value(spark, F.struct(*[c.alias(n) for c, n in zip(N.euler(F.array(*[F.lit(float(x)) for x in m.ravel()])), "ypr")]))
    assert [round(found[c], 6) for c in "yp"] == [30, -20]


def test_text_keys(spark):
    assert value(spark, X.clip_and_track(F.lit("dual_2_t1"))).asDict() == {"clip_id": "dual_2", "track_id": 1}
    assert [tuple(s) for s in value(spark, X.line_scores(F.lit("1: 7.5\nnothing\n2) 12")))] == [(1, 7.5), (2, 10.0)]
    assert value(spark, X.subject_query(F.lit("face:a/b.png")))["path"] == "a/b.png" and value(spark, X.subject_query(F.lit("other"))) is None
    assert value(spark, X.source_uri(F.lit("a/b.mp4"), "home")) == "s3://home/a/b.mp4"


def test_gradient_and_boxcar_follow_numpy(spark):
    x = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0, 5.0, 3.0, 5.0, 8.0, 9.0]
    own = track(spark, x)
    assert np.allclose(column(own.withColumn("g", W.gradient(F.col("x"), ["t"], "f")), "g"), np.gradient(x))
    for win in (2, 3, 6, 12):
        assert np.allclose(column(own.withColumn("s", W.boxcar(F.col("x"), ["t"], "f", win)), "s"), np.convolve(x, np.ones(win) / win, "same"))
    assert column(track(spark, [1.0]).withColumn("g", W.gradient(F.col("x"), ["t"], "f")), "g") == [None]


def test_greedy_separation_matches_plain_python(spark):
    rng = random.Random(1)
    for k, gap in ((3, 1), (3, 4), (5, 7)):
        v = [float(rng.randint(0, 20)) for _ in range(120)]
        picks = []
        for f in sorted(range(120), key=lambda f: (-v[f], f)):
            if len(picks) < k and all(abs(f - p) >= gap for p in picks):
                picks.append(f)
        assert column(K.greedy_separated(track(spark, v), ["t"], "f", "x", k, gap), "f", "pick") == picks


def test_relaxed_top(spark):
    rows = spark.createDataFrame([(1, f, s) for f, s in zip(range(0, 36, 6), [6.0, 5.0, 4.0, 3.0, 2.0, 1.0])], "t long, f long, x double")
    strict = K.relaxed_top(rows, ["t"], "f", "x", [("all", F.lit(True)), ("any", F.lit(True))], [12, 6, 0])
    assert column(strict, "f", "pick") == [0, 12, 24] and set(column(strict, "note", "pick")) == {"all"}
    few = K.relaxed_top(rows.where("f <= 12"), ["t"], "f", "x", [("none", F.lit(False)), ("score only", F.lit(True))], [0])
    assert column(few, "f", "pick") == [0, 6, 12] and set(column(few, "note", "pick")) == {"score only"}


def test_best_per_bin_falls_back(spark):
    rows = spark.createDataFrame([(1, 0, "a", 9.0, False), (1, 1, "a", 5.0, True), (1, 2, "b", 3.0, False), (1, 3, "b", 3.0, None)], "t long, f long, b string, x double, ok boolean")
    found = {r["b"]: (r["f"], r["preferred"]) for r in K.best_per_bin(rows, ["t"], "b", "x", "f", F.col("ok")).collect()}
    assert found == {"a": (1, True), "b": (2, False)}


def test_evenly_spaced_follows_linspace(spark):
    for n, k in ((50, 7), (7, 7), (8, 7), (3, 7), (20, 2)):
        found = column(K.evenly_spaced(track(spark, [0.0] * n), ["t"], "f", k), "f")
        assert found == sorted({int(x) for x in np.linspace(0, n - 1, k)} if n > k else range(n)), (n, k)


def test_nearest_in_time(spark):
    left = spark.createDataFrame([(1, 5), (1, 10), (1, 7), (2, 1)], "t long, at long")
    right = spark.createDataFrame([(1, 4, "a"), (1, 6, "b"), (1, 20, "c")], "t long, at long, v string")
    found = {(r["t"], r["at"]): r["nearest"] for r in J.nearest_in_time(left, right, ["t"], "at", "v").collect()}
    assert found == {(1, 5): "a", (1, 10): "b", (1, 7): "b", (2, 1): None}


def test_strict_alignment_loses_whole_tracks(spark):
    base = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "t long, f long")
    other = spark.createDataFrame([(1, 0, 5.0), (2, 0, 6.0)], "t long, f long, v double")
    assert {(r["t"], r["f"]): r["v"] for r in J.strictly_aligned(base, other, ["t"], "f").collect()} == {(1, 0): None, (1, 1): None, (2, 0): 6.0}


def test_runs(spark):
    own = track(spark, [float(x) for x in (1, 1, 0, 1, 0, 0, 0, 1, 1, 0, 1, 1)])
    found = [(r["first"], r["last"], r["n"]) for r in W.runs(own, F.col("x") > 0, ["t"], "f", 2, 3).orderBy("first").collect()]
    assert found == [(0, 3, 3), (7, 11, 4)]
    held = column(W.in_sustained_run(own, F.col("x") > 0, ["t"], "f", "h"), "h")
    assert held == [True, True, False, True, False, False, False, True, True, False, True, True]


def test_merged_distribution_is_associative(spark):
    rng = random.Random(3)
    rows = spark.createDataFrame([(rng.randint(0, 3), rng.randint(0, 4), rng.gauss(5, 2) if rng.random() < 0.9 else None) for _ in range(400)], "a long, b long, x double")
    once = A.distribution(rows, ["a"], "x").orderBy("a").collect()
    twice = A.merged_distributions(A.distribution(rows, ["a", "b"], "x"), ["a"]).orderBy("a").collect()
    assert np.allclose([tuple(r) for r in once], [tuple(r) for r in twice])


def test_rules_resolve_before_they_run(spark):
    own = track(spark, [1.0, 2.0, None])
    rules = [Rule("big", ("x",), lambda: F.col("x") > 1), Rule("held", ("big", "x"), lambda: F.col("big") | F.col("x").isNull())]
    assert column(evaluated(own, rules), "held") == [False, True, True]
    with pytest.raises(ValueError, match="nothing"):
        evaluated(own, [Rule("bad", ("nothing",), lambda: F.lit(True))])
    p = presets.preset("default")
    assert unresolved([*gates.validity(["t"], p), *gates.policy_and_views(p)], gates.SIGNALS) == []
    with pytest.raises(KeyError):
        presets.preset("none")


def test_gate_reasons_of_missing_signals(spark):
    blank = spark.createDataFrame([(1, f) for f in range(4)], "t long, f long").withColumns({s: F.lit(None).cast("double") for s in gates.SIGNALS})
    found = gates.judged(blank, ["t"], "f", presets.preset("default"))
    assert {r["reason"] for r in found.collect()} == {"reject:identity"}
    good = blank.withColumns({"blink": F.lit(0.1), "smile": F.lit(0.35), "jaw": F.lit(0.1), "mesh_yaw": F.lit(2.0), "yaw": F.lit(2.0), "pitch": F.lit(0.0), "roll": F.lit(0.0), "eyes_vis": F.lit(1.0), "mouth_vis": F.lit(0.5), "eye_lum_rel": F.lit(1.0)})
    assert {r["reason"] for r in gates.judged(good, ["t"], "f", presets.preset("default")).collect()} == {"admit"}


def test_stitching(spark):
    e = {1: [1.0, 0.0], 2: [0.9, 0.1], 3: [0.0, 1.0], 4: [0.95, 0.05]}
    frames = {1: [0, 1], 2: [2, 3], 3: [0, 2], 4: [1, 5]}
    rows = spark.createDataFrame([("c", t, f, e[t]) for t, fs in frames.items() for f in fs], "clip string, track long, frame long, embedding array<double>")
    found = {r["track"]: r["subject"] for r in subjects.stitched(rows, "clip", "frame", "track", "embedding").collect()}
    assert found == {1: 1, 2: 1, 4: 1, 3: 3}  # 4 meets 1 in a frame, but joins it through 2


def test_joined_fragments(spark):
    rows = spark.createDataFrame([("c", 1, [0, 1, 2, 3], [4.0, 0.0, 0.0]), ("c", 2, [5], [0.8, 0.6, 0.0]), ("c", 3, [1, 2], [0.0, 0.0, 2.0])], "clip string, track long, frames array<long>, total array<double>")
    assert {r["track"]: r["subject"] for r in kernels.joined_fragments(rows, "clip", "track").collect()} == {1: 1, 2: 1, 3: 3}


def test_segments(spark):
    fall = lambda n: [0.1 - 0.001 * i for i in range(n)]
    level = fall(10) + [1.0, 3.0, 5.0, 3.0, 1.0] + fall(10) + [1.0, 2.5, 4.0, 2.5, 1.0] + fall(5)
    rows = [("c", i, i * 500, v, v, 0.5 + (i == 12) * 0.1, 0.2, 0.5, v, float(i > 20)) for i, v in enumerate(level)]
    df = spark.createDataFrame(rows, "clip string, frame_idx long, timestamp_ms long, level double, score double, which double, valence double, arousal double, a double, b double")
    found = [(r["rank"], r["peak_frame"], r["start_ms"], r["score"]) for r in kernels.segments(df, ["clip"], ["a", "b"]).orderBy("rank").collect()]
    assert found == [(1, 12, 4500, 5.0), (2, 27, 12000, 4.0)]


def test_rarity_matches_plain_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 2))
    df = track(spark, [(float(a), float(b)) for a, b in x], "a double, b double")
    got = column(kernels.rarity(df, ["t"], "f", ["a", "b"], 6), "rarity")
    w = np.stack([x[i : i + 6].mean(0) for i in range(55)])
    gap = np.sqrt(((w[:, None] - w[None]) ** 2).sum(-1))
    np.fill_diagonal(gap, np.inf)
    want = np.sort(gap, 1)[:, :5].mean(1)
    assert got[:3] == [None] * 3 and np.allclose(got[3:58], want) and got[58:] == [None] * 2
    spread = kernels.rarity(df, ["t"], "f", ["a", "b"], 6, share=7)  # eight tasks for one track
    assert column(spread, "rarity") == got
    short = track(spark, [(float(a), float(b)) for a, b in x[:20]], "a double, b double").withColumn("t", F.lit(None).cast("long"))
    assert column(kernels.rarity(short, ["t"], "f", ["a", "b"], 6), "rarity") == [None] * 20


def test_canonical_shape_forgets_place_and_pose(spark):
    rng = np.random.default_rng(4)
    face = rng.normal(size=(478, 3)) * 0.05
    rows = []
    for turn in (0.0, 0.7, -1.1):
        r = np.array([[math.cos(turn), 0, math.sin(turn)], [0, 1, 0], [-math.sin(turn), 0, math.cos(turn)]])
        m = np.eye(4)
        m[:3, :3] = r
        seen = (face @ r.T) * np.array([1, -1, -1]) + rng.uniform(-5, 5, 3)
        rows.append(([float(x) for x in seen.ravel()], [float(x) for x in m.ravel()], [0.0, 0.0, 1.0, 1.0]))
    df = spark.createDataFrame(rows, "p array<double>, m array<double>, c array<double>")
    shapes = np.array([r["s"] for r in df.select(kernels.canonical_shape(F.col("p"), F.col("m"), F.col("c")).alias("s")).collect()]).reshape(3, 478, 3)
    assert np.abs(shapes - shapes[0]).max() < 1e-7
    assert np.abs(shapes[0][:468].mean(0)).max() < 1e-9 and abs(math.sqrt((shapes[0][:468] ** 2).sum(1).mean()) - 1) < 1e-9


def test_dense_kernels(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 4))
    df = spark.createDataFrame([(1, i, [float(v) for v in row], [float(2 * row[0] + 1)]) for i, row in enumerate(x)], "t long, f long, v array<double>, y array<double>")
    summary = moments.shape_summary(df, ["t"], "f", "v").first()
    assert np.allclose(summary["centre"], np.median(x, 0)) and abs(summary["drift"] - math.sqrt(((np.median(x[:20], 0) - np.median(x[20:], 0)) ** 2).mean())) < 1e-12
    fit = moments.ridge(df, ["t"], "v", "y").first()
    assert abs(fit["intercept"][0] - 1) < 0.05 and fit["explained"] > 0.99
    two = centres.two_means(track(spark, [1.0, 1.1, 0.9, 5.0, 5.1, None]), ["t"], "x").first()
    assert two["split"] and 2.5 < two["threshold"] < 3.5
    colours = [(1, [10.0, 1.0, 1.0])] * 150 + [(1, [60.0, 40.0, 0.0])] * 100 + [(2, [1.0, 1.0, 1.0])] * 10
    made = {r["t"]: r for r in centres.palette(spark.createDataFrame(colours, "t long, lab array<double>"), ["t"], "lab").collect()}
    assert made[2]["colours"] is None and made[1]["colours"][made[1]["chroma_at"]]["lab"][0] == 60.0


def test_median_and_mean_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 10.0]), (1, [8.0, 3.0])], "t long, v array<double>")
    assert mean_vector(df, ["t"], "v", "m").first()["m"] == [4.0, 5.0] and mean_vector(df, ["t"], "v", "m", robust=True).first()["m"] == [3.0, 3.0]


def test_catalog(spark):
    own = catalog.catalog(spark)
    assert catalog.unresolved_reads(own).collect() == []
    place = {r["analysis"]: r["place"] for r in catalog.numbered(own).collect()}
    assert all(place[r["upstream"]] < place[r["analysis"]] for r in catalog.edges(own).collect())
    need = {r["analysis"]: r["role"] for r in catalog.closure(spark, own, ["recipe"]).collect()}
    assert need["recipe"] == "final" and need["detect"] == "input" and "portrait" not in need
    loop = spark.createDataFrame([("a", ["y"], ["x"]), ("b", ["x"], ["y"])], own.schema)
    with pytest.raises(ValueError, match="cycle"):
        catalog.levels(loop)
    made = spark.createDataFrame([("a", 100.0), ("u1", 50.0), ("u2", 99.0), ("u3", 100.5), ("u4", 100.0), ("b", 100.0), ("c", 100.0), ("d", None)], "artifact string, made_at double").withColumn("code_at", F.lit(1.0))
    links = spark.createDataFrame([("u1", "a"), ("u2", "a"), ("u1", "b"), ("u3", "b"), ("u4", "c")], "upstream string, artifact string")
    assert {r["artifact"]: r["stale"] for r in catalog.stale(made, links).where("artifact in ('a','b','c','d')").collect()} == {"a": False, "b": True, "c": False, "d": True}
    names = spark.createDataFrame([("likeness.json",), ("run.json",), ("cards.html",), ("tubelets.parquet",), ("mystery.bin",)], "name string")
    assert [r["tier"] for r in catalog.tiered(names, "name").collect()] == ["product", "ops", "surface", "substrate", "unclassified"]


def test_evaluation(spark):
    verdicts = spark.createDataFrame([("l", 1, 0, 1, "a", "a"), ("l", 1, 1, 2, "a", "b"), ("l", 1, 0, 2, "b", "tie"), ("l", 1, 0, 9, "b", "a")], "lane string, t long, a_frame long, b_frame long, system_pref string, winner string")
    row = evals.agreement(verdicts, "lane").first()
    assert (row["n"], row["ties"], round(row["agreement"], 4)) == (4, 1, 0.3333)
    again = evals.rescored(verdicts, track(spark, [1.0, 3.0, 2.0]), ["t"], "f", "x").collect()
    assert sorted((r["a_frame"], r["b_frame"], r["system_pref"]) for r in again) == [(0, 1, "b"), (0, 2, "b"), (1, 2, "a")]
    old = spark.createDataFrame([(1, 1.0, "x"), (2, float("nan"), "y"), (3, 1.0, None)], "k long, v double, s string")
    new = spark.createDataFrame([(1, 1.0 + 1e-9, "x"), (2, float("nan"), "z"), (4, 0.0, None)], "k long, v double, s string")
    assert sorted((r["k"], r["field"]) for r in evals.differences(old, new, ["k"]).collect()) == [(2, "s"), (3, "s"), (3, "v"), (4, "s"), (4, "v")]


def test_sources(spark, tmp_path):
    rows = spark.createDataFrame([("c1", 1, 0, 1.0, float("nan"), 3.0)], "clip_id string, track_id long, frame_idx long, yaw double, pitch double, roll double")
    root = str(tmp_path)
    tables.write_table(rows, root, "headpose")
    tables.write_table(rows.withColumn("clip_id", F.lit("c2")), root, "headpose")
    back = tables.read_table(spark, root, "headpose")
    assert back.count() == 2 and back.first()["pitch"] is None
    assert tables.read_optional(spark, root, "parse").columns == schemas.schema("parse").names
    with pytest.raises(ValueError, match="missing"):
        tables.write_table(rows.drop("yaw"), root, "headpose")
    labels = spark.createDataFrame([("c", 10, "r", "pos", 1, 0), ("c", 20, "r", "pos", 1, 1), ("c", 10, "r", "neg", 2, 2), ("c", 30, "r", "pos", 1, 3)], "clip string, frame long, role string, flag string, ts long, seq long")
    path = f"{root}/gt"
    tables.upsert(spark, path, labels, ["clip", "frame", "role"], "ts", "seq", "flag")
    tables.upsert(spark, path, spark.createDataFrame([("c", 30, "r", None, 5, 9)], labels.schema), ["clip", "frame", "role"], "ts", "seq", "flag")
    assert sorted((r["frame"], r["flag"]) for r in read_published(spark, path, labels.schema).collect()) == [(10, "neg"), (20, "pos")]
    (tmp_path / "log.jsonl").write_text('{"a": 1}\n\nbroken\n{"a": 2}\n')
    from pyspark.sql import types as T

    kind = T.StructType.fromDDL("a long")
    assert sorted(r["a"] for r in tables.read_records(spark, f"{root}/log.jsonl", kind).where("a is not null").collect()) == [1, 2]
    assert tables.read_records(spark, f"{root}/none.jsonl", kind).collect() == []
    counted = tables.read_records(spark, f"{root}/log.jsonl", kind, broken="line").collect()
    assert [r["line"] for r in counted if r["line"] is not None] == ["broken"] and len(counted) == 3
    with pytest.raises(ValueError, match="a is string"):
        schemas.require(spark.createDataFrame([("x",)], "a string"), kind)
    found = tables.provenance(spark, f"{root}/log.jsonl", "first")
    assert found.first()["bytes"] == 26
    assert tables.first_seen(found, found.withColumn("origin", F.lit("second")), "sha256").first()["origin"] == "first"


def test_emotion_baseline_and_worn(spark):
    rows = spark.createDataFrame([(1, i, float(i), "happy" if i > 20 else "sad", True) for i in range(40)] + [(2, i, float(i), "sad", False) for i in range(8)], "t long, f long, valence double, label string, ride boolean")
    base = {r["t"]: r for r in readings.emotion_baseline(rows, ["t"], "f", F.col("ride"), "label").collect()}
    assert base[1]["p50"] == 19.5 and base[1]["high_label"] == "happy" and base[1]["low_label"] == "sad" and base[2]["n"] == 8
    worn = readings.worn(rows, ["t"], {"hat": F.when(F.col("f") % 2 == 0, F.col("valence") >= 0)}).where("t = 1").first()
    assert worn["hat_share"] == 0.5 and worn["hat"] == "variable"


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(i % 3, float(i), f"2024-01-01 00:00:{i:02d}") for i in range(30)], "user long, value double, t string").withColumn("ts", F.col("t").cast("timestamp"))
    for i, part in enumerate(rows.randomSplit([0.5, 0.5], 1)):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found = streams.drained(streams.running_distribution(stream(), "user", "value"), ["user"], f"{tmp_path}/a").orderBy("user").collect()
    assert [(r["n"], round(r["mean"], 9)) for r in found] == [(10, 13.5), (10, 14.5), (10, 15.5)]
    beats = streams.drained(streams.beats(stream(), "ts", ["user"], "10 seconds", "1 hour"), ["user", "w"], f"{tmp_path}/b")
    assert beats.agg(F.sum("n"), F.count("*")).first() == (30, 9)


def test_recipe_probes_and_replies(spark):
    rows = spark.createDataFrame([("c_t1", (0.1234567, "mid")), ("c_t2", (None, "low"))], "image_id string, axes struct<a:double,b:string>")
    registry = spark.createDataFrame([("G01", "a", "cont", 0.0, 1.0), ("G02", "b", "cat", None, None), ("H01", "c", "cont", 0.0, 1.0)], "axis_id string, name string, type string, lo double, hi double")
    filled, unfilled = readings.recipe(rows, "image_id", "axes", registry)
    assert sorted((r["image_id"], r["axis_id"], r["value_num"], r["value_cat"]) for r in filled.collect()) == [("c_t1", "G01", 0.123457, None), ("c_t1", "G02", None, "mid"), ("c_t2", "G02", None, "low")]
    assert sorted(tuple(r) for r in unfilled.collect()) == [("c_t1", "H01"), ("c_t2", "G01"), ("c_t2", "H01")]
    rng = random.Random(2)
    scored = spark.createDataFrame([(1, x, 2 * x + rng.random() * 0.1, rng.random(), 1.0) for x in (rng.random() for _ in range(40))], "t long, p1 double, yaw double, blur double, flat double")
    found = readings.component_probes(scored, ["t"], ["p1"], ["yaw", "blur", "flat"]).orderBy("rank").collect()
    assert [r["probe"] for r in found] == ["yaw", "blur"] and found[0]["corr"] > 0.99
    candidates = spark.createDataFrame([("c", 1), ("c", 2), ("c", 3)], "clip string, i int")
    ranked = scores.ranked_by_reply(candidates, spark.createDataFrame([("c", "1: 2\n3: 9.5")], "clip string, reply string"), "clip", "i").orderBy("rank").collect()
    assert [(r["i"], r["language_score"]) for r in ranked] == [(3, 9.5), (1, 2.0), (2, 0.0)]


def test_split_half_drift(spark):
    rows = [("a", i, [0.0, 0.0, 0.0] if i < 5 else [3.0, 0.0, 4.0]) for i in range(11)] + [("b", i, [float(i)] * 3) for i in range(9)] + [("b", 99, None)]
    own = spark.createDataFrame(rows, "t string, i long, v array<double>")
    got = {r["t"]: (r["n"], r["drift"]) for r in W.split_half_drift(own, ["t"], "i", "v").collect()}
    assert got == {"a": (11, 5.0), "b": (9, None)}
    assert W.split_half_drift(own.limit(0), ["t"], "i", "v").count() == 0


def test_sharing_frames(spark):
    rows = spark.createDataFrame([("c", 1, 1), ("c", 1, 2), ("c", 1, 2), ("c", 2, 3), ("d", 2, 1), (None, 1, 3)], "clip string, frame long, s long")
    pairs = spark.createDataFrame([("c", 1, 2), ("c", 1, 3), ("d", 1, 3), ("c", 1, None)], "clip string, a long, b long")
    got = {(r["clip"], r["a"], r["b"]): r["overlap"] for r in J.sharing_frames(pairs, rows, ["clip"], "frame", "s").collect()}
    assert got == {("c", 1, 2): True, ("c", 1, 3): False, ("d", 1, 3): False, ("c", 1, None): False}


def test_robust_z_of_several_columns_takes_two_windows(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, None), ("a", 4.0, 2.0, 1.0), ("a", 9.0, 8.0, 3.0), (None, 1.0, 1.0, 1.0)], "t string, x double, y double, z double")
    both = W.robust_zs(df, {"x": "zx", "y": "zy", "z": "zz"}, ["t"], positive=True)
    assert both._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 2
    one = df
    for c in "xyz":
        one = W.robust_z(one, c, ["t"], f"z{c}", positive=True)
    assert sorted(map(str, both.collect())) == sorted(map(str, one.select(*both.columns).collect()))
