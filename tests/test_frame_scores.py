"""The record of all scores: short tracks, missing readings, the start of the ride, and how often its rows are exchanged."""

from pyspark.sql import functions as F

from tracewell.plans.scores import SCORES, frame_scores, portrait_objective
from tracewell.queries.records import CHANGES, READINGS, q01

NUMBERS = [n for n in READINGS if n not in ("valid", "scene_phase")]


def frames(spark, rows):
    """rows: track, frame, phase, readings that are not missing."""
    ddl = ", ".join(["track_id string", "frame_idx int", "scene_phase string", "valid boolean", *[f"{n} double" for n in NUMBERS]])
    return spark.createDataFrame([(t, i, phase, True, *[own.get(n) for n in NUMBERS]) for t, i, phase, own in rows], ddl)


def test_missing_readings_and_the_start_of_the_ride(spark):
    rows = [("a", i, "ride" if i >= 4 else None, {"valence": 0.5, "det": 1.0, "yaw": 12.0, "em_conf": 1.0}) for i in range(30)]
    rows += [("one", 0, "ride", {"valence": 0.2}), ("none", 0, None, {}), ("none", 1, "ride", {}), (None, 0, "ride", {"valence": -1.0, "det": 1.0}), (None, 1, "ride", {"valence": 1.0, "det": 1.0})]
    out = frame_scores(frames(spark, rows), ["track_id"], "frame_idx", CHANGES)
    assert out.columns == ["track_id", "frame_idx", *SCORES, "is_ride", "impact_terms", "portrait_terms"]
    got = {(r.track_id, r.frame_idx): r for r in out.collect()}
    assert len(got) == len(rows)
    for i in range(30):  # 3 seconds of 6 frames from frame 4 on
        r = got["a", i]
        assert r.is_ride == (i >= 4) and (r.when is not None) == (i >= 22) and (r.highlight is not None) == (i >= 22)
        assert abs(r.which - 0.75) < 1e-9 and r.rarity is None and r.scene is None
    assert abs(got["a", 29].when - 1.5) < 1e-9 and abs(got["a", 29].rank_sig - 1.5 * 0.75) < 1e-9
    assert got["none", 0].which is None and got["none", 1].when is None and got["one", 0].which == 0.0
    assert got[None, 0].which == 0.0 and got[None, 1].which > 0
    terms = got["none", 1].portrait_terms
    assert (terms.eyes, terms.pleasant, terms.light, terms.typical, terms.seen) == (0.75, 0.5, 1.0, 1.0, 0.0)
    assert out.where("false").count() == 0 and frame_scores(frames(spark, rows).where("false"), ["track_id"], "frame_idx", CHANGES).count() == 0


def test_one_exchange(spark, capsys):
    rows = frames(spark, [("a", i, "ride", {"valence": 0.1 * i}) for i in range(3)])
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        frame_scores(rows, ["track_id"], "frame_idx", CHANGES).explain()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning") == 1


def test_channels_agree_with_their_scores(spark):
    own = q01(spark, "/root/testdata/sf0.001").where("`when` is not null and rarity is not null and scene is not null and impact is not null")
    assert own.where("`when` + 1e-3 < greatest(impact, rarity, scene)").count() == 0 and own.where(F.col("highlight") < F.col("rank_sig") - 1e-3).count() == 0


def test_objective_without_blink_or_blur(spark):
    rows = [("a", 0, 10.0, None, None, 50.0, None, None), ("a", 1, 10.0, 1.0, 1.0, 100.0, None, 0.225), ("b", 0, 0.0, 0.0, 0.0, None, 0.19, 0.3), ("b", 1, None, 0.0, 0.0, 3.0, 0.19, 0.3)]
    df = spark.createDataFrame(rows, "t string, f long, yaw double, pitch double, roll double, blur double, query_dist double, blink double").selectExpr("*", "CAST(NULL AS DOUBLE) AS em_conf", "CAST(NULL AS DOUBLE) AS em_vel")
    got = {(r["t"], r["f"]): r["objective"] for r in portrait_objective(df, ["t"]).collect()}
    assert got == {("a", 0): round(5 / 6 + 0.5 + 1, 4), ("a", 1): round(0.8 + 1 + 0.5, 4), ("b", 0): 1.5, ("b", 1): None}
