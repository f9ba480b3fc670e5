"""The frame gates: validity, portrait policy and view routing, with a reason for each frame."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.numbers import point_distance, view_class
from tracewell.functions.vectors import mean_vector
from tracewell.operators.aggregates import cohort_median, supported_median
from tracewell.operators.joins import rivals_by_vector
from tracewell.operators.rules import Rule, evaluated, first_reason, readers
from tracewell.operators.windows import in_sustained_run
from tracewell.plans.presets import Preset

#: What the gates read from the frame table; any of them may be NULL.
SIGNALS = ("blink", "smile", "jaw", "mesh_yaw", "wide_yaw", "yaw", "pitch", "roll", "skin_entropy", "eye_lum_rel", "mouth_vis", "eyes_vis", "blur", "iddev", "cos_self", "cos_other", "em_conf")
# fixed values: the authored expression and the weight of each part
TARGET = {"blink": 0.0, "smile": 0.35, "jaw": 0.1}
WEIGHT = {"blink": 1.0, "smile": 1.0, "jaw": 0.5}


def validity(keys: Sequence[str], p: Preset) -> list[Rule]:
    """Is there a face here, and is it this person's?"""
    c = F.col
    gate = Rule

    def ref(name, reads, make):
        return Rule(name, reads, make, is_gate=False)

    return [
        gate("have_bs", ("blink",), lambda: c("blink").isNotNull()),
        gate("pose_finite", ("yaw",), lambda: c("yaw").isNotNull()),
        gate("mask_valid", ("skin_entropy",), lambda: c("skin_entropy").isNotNull()),
        ref("pose_class", ("mesh_yaw", "wide_yaw"), lambda: F.coalesce(view_class(c("mesh_yaw"), c("wide_yaw"), p.frontal_yaw, p.side_yaw, p.side_agree), F.lit("angle"))),
        gate("side_pose", ("pose_class",), lambda: c("pose_class") == "side"),
        gate("frontal_clean", ("pose_class", "have_bs"), lambda: (c("pose_class") == "frontal") & c("have_bs")),
        # worn things are only judged on clean frontal frames
        gate("sunglasses", ("eye_lum_rel", "frontal_clean"), lambda: (c("eye_lum_rel") < p.sunglasses_below) & c("frontal_clean")),
        gate("masked", ("mouth_vis", "frontal_clean"), lambda: (c("mouth_vis") < p.masked_below) & c("frontal_clean")),
        gate("face_present", ("eyes_vis", "mouth_vis", "frontal_clean"), lambda: F.coalesce((c("eyes_vis") > 0) | (c("mouth_vis") > 0), c("eyes_vis").isNull() & c("mouth_vis").isNull()) | ~c("frontal_clean")),
        ref("blur_floor", ("blur",), lambda: supported_median(c("blur"), keys, p.blur_least, p.blur_part, -1e308)),
        gate("sharp_ok", ("blur", "blur_floor"), lambda: F.coalesce(c("blur"), c("blur_floor")) >= c("blur_floor")),
        gate("exposure_ok", ("skin_entropy", "mask_valid"), lambda: ~c("mask_valid") | (c("skin_entropy") >= p.entropy_least)),
        ref("clean_ref", ("iddev", "frontal_clean"), lambda: cohort_median(c("iddev"), c("frontal_clean"), keys)),
        gate("id_ok", ("iddev", "clean_ref"), lambda: c("iddev") <= c("clean_ref") + p.identity_slack),
        gate("anchored", ("clean_ref",), lambda: c("clean_ref") <= p.anchor_most),
        gate("id_valid", ("id_ok", "anchored", "cos_self", "cos_other", "side_pose"), lambda: c("id_ok") | F.coalesce(_resembles_self(p), F.lit(False))),
        gate("face_or_fashion", ("face_present", "sunglasses", "masked"), lambda: c("face_present") | c("sunglasses") | c("masked")),
        gate("valid", ("face_or_fashion", "have_bs", "id_valid"), lambda: c("face_or_fashion") & (c("have_bs") | c("id_valid"))),
    ]


def _resembles_self(p: Preset):
    """Nearer to the own centroid than to any rival's: needs a trusted anchor, and more of it the less the view explains."""
    own, rival = F.coalesce("cos_self", F.lit(-1.0)), F.col("cos_other")
    apart = rival.isNull() | (own - rival >= p.rival_margin)
    enough = (own >= p.self_strong) | (F.col("side_pose") & (own >= p.self_side)) | (rival.isNotNull() & (own >= p.self_gross))
    return F.col("anchored") & apart & enough


def policy_and_views(p: Preset) -> list[Rule]:
    """Is it a portrait, and from which side?"""
    c = F.col
    profile = lambda: ~c("have_bs") | (c("pose_class") == "side")
    distance = lambda: point_distance({k: c(k) for k in TARGET}, TARGET, WEIGHT)
    face = ("have_bs", "pose_finite", "eyes_ok", "expr_ok", "query_ok", "jaw", "sharp_ok", "exposure_ok")
    fit = lambda: c("have_bs") & c("pose_finite") & c("eyes_ok") & c("expr_ok") & c("query_ok") & (c("jaw") < p.jaw_most) & c("sharp_ok") & c("exposure_ok")
    return [
        Rule("eyes_ok", ("sunglasses", "blink"), lambda: c("sunglasses") | F.coalesce(c("blink") < p.blink_most, F.lit(False))),
        Rule("query_dist", tuple(TARGET), distance, is_gate=False),
        Rule("query_ok", ("have_bs", "pose_class", "query_dist"), lambda: profile() | (F.coalesce("query_dist", F.lit(0.0)) <= p.query_most)),
        Rule("expr_ok", ("have_bs", "pose_class", "em_conf"), lambda: profile() | (F.coalesce("em_conf", F.lit(1.0)) >= p.expression_least)),
        Rule("face_fit", face, fit),
        Rule("frontal_pose", ("face_fit", "yaw", "pitch", "roll"), lambda: c("face_fit") & (F.abs("yaw") < p.pose_most) & (F.abs("pitch") < p.pose_most) & (F.abs("roll") < p.pose_most)),
        Rule("admit", ("frontal_pose", "valid"), lambda: c("frontal_pose") & c("valid")),
        Rule("quarter_ok", ("face_fit", "valid"), lambda: c("face_fit") & c("valid")),
        Rule("side_raw", ("side_pose", "sharp_ok", "exposure_ok", "valid"), lambda: c("side_pose") & c("sharp_ok") & c("exposure_ok") & c("valid")),
    ]


def judged(frames: DataFrame, keys: Sequence[str], frame: str, p: Preset, open_identity: bool = False) -> DataFrame:
    """frames with every gate, side_ok (side frames in a sustained run) and reason.

    A frame without a cosine to its own centroid resembles nobody and is rejected for identity, if nothing else makes it valid. With open_identity
    the question stays open under a trusted anchor, as it does in SQL, where `valid` is NULL then: such a frame is as little valid, but its reason is a later one.
    """
    out = evaluated(frames, [*validity(keys, p), *policy_and_views(p)])
    return _with_reason(_with_side(out, keys, frame, p), p, open_identity)


def _with_side(out: DataFrame, keys: Sequence[str], frame: str, p: Preset) -> DataFrame:
    return in_sustained_run(out, F.col("side_raw"), keys, frame, "side_ok", p.side_gap, p.side_run)


def _with_reason(out: DataFrame, p: Preset, open_identity: bool) -> DataFrame:
    c = F.col
    unread = c("cos_self").isNull() & c("anchored") & F.lit(open_identity)
    cases = [
        (c("admit"), "admit"),
        (~c("valid") & ~c("face_or_fashion"), "reject:no_face"),
        (~c("valid") & ~unread, "reject:identity"),
        (~c("sharp_ok"), "reject:blur"),
        (~c("exposure_ok"), "reject:exposure"),
        (~c("expr_ok"), "reject:ambiguous"),
        (c("side_ok"), "side"),
        (c("quarter_ok"), "quarter"),
    ]
    return out.withColumn("reason", first_reason(cases, "no_view"))


#: Gates that the reason reads besides those that read the cosines.
_REASONS = ("face_or_fashion", "sharp_ok", "exposure_ok", "expr_ok")


def judged_twice(
    frames: DataFrame, vectors: DataFrame, clip: str, track: str, frame: str, at: str, embedding: str, p: Preset, parts: int | None = None, cells: int = 1, spread: int | None = None, clips: DataFrame | None = None, open_identity: bool = False
) -> DataFrame:
    """Two passes: the frames admitted without embedding evidence give each track a centroid (from centroid_least frames on); the second
    pass also knows how near a frame is to its own and to the nearest other centroid of its clip. clip, track, frame, cos_self, cos_other, the gates that read them, and reason.

    A frame names its embedding by `at`, its id in `vectors`, so none travels with the frames. What does is the outcome of the gates that read no cosine, as bits of one number: the second pass judges only the others again.
    Of its frames only those that may be side frames, as those gates say, go back to their tracks for the runs; cosines are taken for either kind of frame by itself, since what a task makes can't be sent on in part.
    frames are best dealt by track; vectors of admitted frames and frames that may be side frames are dealt by track over `parts` partitions, the cosines' groups (`cells` a clip) over `spread` (None: the session's). clips: see `groups` of rivals_by_vector.
    """
    keys, rules = [clip, track], [*validity([clip, track], p), *policy_and_views(p)]
    deal = lambda rows: rows if parts is None else rows.repartition(parts, *keys)
    again = readers(rules, ["cos_self", "cos_other"])
    known = sorted({*_REASONS, *[name for rule in again for name in rule.reads]} - {"cos_self", "cos_other", *[rule.name for rule in again]})
    first = evaluated(frames.withColumns({"cos_self": F.lit(None).cast("double"), "cos_other": F.lit(None).cast("double")}), rules)
    admitted = first.where("admit").select(*keys, at).withColumn("__n", F.count("*").over(Window.partitionBy(*keys))).where(F.col("__n") >= p.centroid_least)
    own = deal(admitted.join(vectors.select(at, F.col(embedding).alias("__v")), at).select(*keys, "__v"))  # as they are stored, which is half the size
    centroids = mean_vector(own, keys, "__v", "__c", unit=True)
    marks = sum((F.when(F.col(name), 1 << i).otherwise(0) for i, name in enumerate(known)), F.lit(0)).alias("__marks")
    near = rivals_by_vector(first.select(*keys, frame, at, marks), vectors, centroids, [clip], track, at, embedding, "__c", cells, spread, clips)
    mark = {name: F.col("__marks").bitwiseAND(F.lit(1 << i)) != 0 for i, name in enumerate(known)}
    side = next(rule for rule in again if rule.name == "side_raw")
    maybe = reduce(lambda a, b: a & b, [mark[name] for name in side.reads if name in mark])
    judged_again = lambda rows: evaluated(rows.withColumns(mark).drop("__marks"), again)
    rest = judged_again(near.where(~maybe)).withColumn("side_ok", F.lit(False))
    sides = _with_side(judged_again(deal(near.where(maybe))), keys, frame, p)
    return _with_reason(rest.unionByName(sides), p, open_identity)
