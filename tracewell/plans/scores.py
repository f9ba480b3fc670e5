"""Per-frame scores of a track: when something happens, which frame shows it best, and what follows from both."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.numbers import clip, mean_of, preference
from tracewell.functions.text import line_scores
from tracewell.operators.windows import burnt_in, filled, gradient, minmax, robust_zs, whole


def when(impact: Column, rarity: Column, scene: Column, valence: Column) -> Column:
    """The strongest of the channels, joy counting three times; missing channels are passed over."""
    return F.greatest(impact, rarity, scene, 3 * F.greatest(valence, F.lit(0.0)))


def which(valence: Column, detection: Column, yaw: Column, em_conf: Column, valid: Column, frontal: float = 12.0, width: float = 30.0) -> Column:
    visible = F.coalesce(detection, F.lit(0.0)) * (0.3 + 0.7 * preference(yaw, frontal, width, 0.25))
    return clip(0.5 + 0.5 * valence, 0.0, 1.0) * visible * (0.4 + 0.6 * F.coalesce(em_conf, F.lit(0.5))) * F.coalesce(valid.cast("double"), F.lit(1.0))


def impact(frames: DataFrame, keys: Sequence[str], order: str, groups: dict[str, tuple[Sequence[str], str]], also: dict[str, str] | None = None) -> DataFrame:
    """frames with impact: the mean over channels of the positive robust z of how fast a channel's signals change.

    groups: channel -> (signals, how): 'sum' adds the absolute gradients (NULLs first taken as the track's median), 'max' takes the greatest (NULL as 0),
    'hypot' their length. The positive robust z of other columns (also: column -> name) comes by the same windows.
    """
    names = sorted({s for signals, _ in groups.values() for s in signals})
    how = {s: kind for signals, kind in groups.values() for s in signals}
    frames = frames.withColumns({f"__f_{s}": F.coalesce(s, F.lit(0.0)) if how[s] == "max" else filled(F.col(s), keys) for s in names})
    frames = frames.withColumns({f"__g_{s}": gradient(F.col(f"__f_{s}"), keys, order) for s in names})
    joints = {}
    for channel, (signals, kind) in groups.items():
        steps = [F.abs(f"__g_{s}") for s in signals]
        joints[f"__c_{channel}"] = F.greatest(*steps) if kind == "max" and len(steps) > 1 else steps[0] if kind == "max" else F.sqrt(sum((s * s for s in steps), F.lit(0.0))) if kind == "hypot" else sum(steps, F.lit(0.0))
    frames = robust_zs(frames.withColumns(joints), {**{f"__c_{c}": f"z_{c}" for c in groups}, **(also or {})}, keys, positive=True)
    frames = frames.withColumn("impact", mean_of([F.col(f"z_{c}") for c in groups]))
    return frames.drop(*[f"__{k}_{s}" for k in "fg" for s in names], *[f"__c_{c}" for c in groups])


def likeness(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """frames with likeness: frontal, calm, sharp and coherent frames score high; boarding frames a little higher than ride frames."""
    quality = minmax(F.col("blur"), keys) - 2 * F.abs(F.col("exposure") - 0.45) - 3 * (F.col("clipped") + F.col("crushed"))
    frames = frames.withColumn("__q", quality)
    front = preference(F.col("yaw"), 12.0, 20.0, 0.05)
    calm = F.coalesce("neutral", F.lit(0.5)) * (1 - 0.5 * F.coalesce("energy", F.lit(0.0)))
    phase = F.when(F.col("scene_phase") == "ride", 1.0).otherwise(1.15)
    score = front * (0.3 + 0.7 * calm) * (0.2 + 0.8 * minmax(F.col("__q"), keys)) * (0.4 + 0.6 * F.coalesce("em_conf", F.lit(0.5))) * phase
    return frames.withColumn("likeness", score).drop("__q")


def portrait_objective(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """frames with objective: frontal, sharp and warm, weighted by coherence and steadiness; 4 places. NULL only without a yaw: a missing pitch, roll or blur counts 0, and
    a frame without a distance to the query is as warm as its eyes are open, fully so where no blink was read."""
    def part(x: Column, most: Column | float) -> Column:
        return clip(x / most, 0.0, 1.0)

    front = 1 - part(F.abs("yaw") + F.coalesce(F.abs("pitch"), F.lit(0.0)) + F.coalesce(F.abs("roll"), F.lit(0.0)), 60.0)
    sharp = F.coalesce(part(F.col("blur"), F.nullif(F.max("blur").over(Window.partitionBy(*keys)), F.lit(0.0))), F.lit(0.0))
    warm = F.coalesce(1 - part(F.col("query_dist"), 0.38), 1 - part(F.coalesce("blink", F.lit(0.0)), 0.45))
    sure = F.coalesce(clip(0.7 + 0.5 * F.col("em_conf"), 0.0, 1.0), F.lit(1.0))
    steady = F.coalesce(clip(1 - 0.3 * F.col("em_vel"), 0.5, 1.0), F.lit(1.0))
    return frames.withColumn("objective", F.round((front + sharp + warm) * sure * steady, 4))


def state_blends(r: Sequence[Column]) -> dict[str, Column]:
    """Face, light, image and distortion, from the unit ranks of stillness, pupils, sharpness, fine detail, size, coherence, visibility and light."""
    still, pupil, sharp, fine, size, coherent, visible, light = r
    return {"face": (2 * still + pupil) / 3, "light": light, "image": (sharp + fine) / 2, "distortion": (coherent + visible + size) / 3}


def ranked_by_reply(candidates: DataFrame, replies: DataFrame, clip_: str, index: str) -> DataFrame:
    """candidates with language_score and rank: scores read from the lines of a clip's reply, 0 where it names none; ties to the lower index."""
    read = replies.select(clip_, F.explode(line_scores(F.col("reply"))).alias("s")).groupBy(clip_, F.col("s.index").alias(index)).agg(F.max("s.score").alias("language_score"))
    joined = candidates.join(read, [clip_, index], "left").withColumn("language_score", F.coalesce("language_score", F.lit(0.0)))
    return joined.withColumn("rank", F.row_number().over(Window.partitionBy(clip_).orderBy(F.desc("language_score"), index)))


#: Seconds from a ride's start that no moment is taken from.
BURN_IN = 3.0


def frame_scores(frames: DataFrame, keys: Sequence[str], order: str, changes: dict[str, tuple[Sequence[str], str]], fps: float = 6.0) -> DataFrame:
    """keys, order and one record of all scores of the frame, with the terms of the composed ones.

    likeness, portrait, which, impact, rarity and scene are there for all frames; when, rank_sig and highlight are NULL outside the ride and in its first seconds. rank_sig is `when`
    without rarity, times which. frames has valence, em_conf, neutral, energy, det, yaw, valid, scene_phase, blur, exposure, clipped, crushed, blink, smile, center_dist, light_lr,
    light_tb, ambient, rarity (as kernels.rarity gives it), scene (a channel of its own scale) and the signals of `changes`, which is impact()'s groups. Any may be NULL: missing channels are
    passed over, missing terms are neutral; so a frame without valence has no `which`. Every window is over the keys, so the rows are exchanged once. Null keys are a track.
    """
    def unit(x: Column) -> Column:
        return minmax(x, keys)

    def zero(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0.0))

    riding = F.coalesce(F.col("scene_phase") == "ride", F.lit(False))
    rows = impact(frames.withColumn("__rare", F.col("rarity")).drop("rarity"), keys, order, changes, {"__rare": "rarity"})
    rows = rows.withColumn("rarity", F.when(F.col("__rare").isNotNull(), F.col("rarity")))  # the positive part of NULL is 0
    rows = likeness(rows.withColumn("scene_phase", F.coalesce("scene_phase", F.lit(""))), keys)
    shows = which(F.col("valence"), F.col("det"), F.col("yaw"), F.col("em_conf"), F.col("valid"))
    rows = rows.withColumns({"is_ride": riding, "which": shows, "__when": when(F.col("impact"), F.col("rarity"), F.col("scene"), F.col("valence"))})
    rows = rows.withColumns({"__rank": F.greatest("impact", "scene", 3 * F.greatest(F.col("valence"), F.lit(0.0))) * F.col("which"), "__high": F.col("__when") * F.col("which")})
    rows = burnt_in(rows, {"__when": "when", "__rank": "rank_sig", "__high": "highlight"}, F.col("is_ride"), keys, order, int(BURN_IN * fps))

    rows = rows.withColumn("__q", unit(F.col("blur")) - 2 * F.abs(F.col("exposure") - 0.45) - 3 * (F.col("clipped") + F.col("crushed")))
    joy, typical = unit(F.greatest(zero("valence"), F.lit(0.0))), 2 * F.coalesce(F.median("center_dist").over(whole(keys)), F.lit(1.0)) + 1e-9
    back = 1 - 0.25 * clip(F.abs(zero("light_tb")) - 0.45, 0.0, 0.5) / 0.5
    terms = {
        "quality": 0.2 + 0.8 * unit(F.col("__q")),
        "eyes": F.coalesce(1 - 0.6 * F.col("blink"), F.lit(0.75)),
        "pleasant": 0.5 + 0.5 * F.coalesce(0.5 * unit(F.col("smile")) + 0.5 * joy, joy),
        "sure": 0.4 + 0.6 * F.coalesce("em_conf", F.lit(0.5)),
        "light": (1 + 0.2 * unit(F.abs(zero("light_lr")))) * back * (1 + 0.2 * unit(zero("ambient"))),
        "typical": F.coalesce(F.exp(-F.pow(F.col("center_dist") / typical, 2)), F.lit(1.0)),
        "seen": zero("det"),
    }
    rows = rows.withColumn("portrait_terms", F.struct(*[x.alias(n) for n, x in terms.items()]))
    portrait = reduce(lambda a, b: a * b, [F.col(f"portrait_terms.{n}") for n in terms])
    rows = rows.withColumns({"portrait": portrait, "impact_terms": F.struct(*[F.col(f"z_{c}").alias(c) for c in changes])})
    return rows.select(*keys, order, *SCORES, "is_ride", "impact_terms", "portrait_terms")


SCORES = ("likeness", "portrait", "which", "impact", "rarity", "scene", "when", "rank_sig", "highlight")
