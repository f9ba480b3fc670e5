"""The highlights of a clip: one line over all its riders, the moments on it, and why each of them was taken."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.kernels import segments
from tracewell.operators.windows import rolling_median

#: What is greatest over riders; the first three and 3 * valence are the channels of `when`, in the order that ties go by.
CHANNELS = ("impact", "rarity", "scene")
SIGNALS = ("when", "rank_sig", "which", "valence", "arousal", *CHANNELS)


def joint_scores(scores: DataFrame, clip: str, frame: str, time: str, state: Sequence[str]) -> DataFrame:
    """clip, frame, time, SIGNALS, state, riders: one row a frame over its riders, who have one row each.

    A signal is the greatest of those present; the state is the mean over the riders who have all of it, 0 if none has. Tasks combine before rows are exchanged.
    """
    whole = reduce(lambda a, b: a & b, [F.col(s).isNotNull() for s in state])
    mean = [F.coalesce(F.avg(F.when(whole, F.col(s))), F.lit(0.0)).alias(s) for s in state]
    return scores.groupBy(clip, frame).agg(F.max(time).alias(time), *[F.max(s).alias(s) for s in SIGNALS], *mean, F.count("*").alias("riders"))


def clip_highlights(scores: DataFrame, clip: str, track: str, role: str, frame: str, time: str, state: Sequence[str], k: int = 3, length_ms: int = 3000) -> DataFrame:
    """clip, n_segs, segs, main_track, riders_joined: one record a clip, with no segs where nothing stands out.

    scores has a row for each rider and frame: SIGNALS and the state, any NULL; frames without a number or a time are passed over. A seg is rank, when_frame (the peak), peak_frame (the best
    to show), start_ms, end_ms, resolved, score, drivers (what each channel gave at the peak) and driver (the greatest; ties to the first channel). A clip's joint line, one row a frame, is one
    task. main_track is the least track that is main anywhere, else the least. Null clips are a clip.
    """
    names = {"clip": clip, "frame_idx": frame, "timestamp_ms": time}
    clash = {*names.values()} & {*SIGNALS, *state}
    if clash:
        raise ValueError(f"columns named as signals: {sorted(clash)}")
    own = scores.select(F.col(clip).alias("clip"), F.col(track).alias("track"), F.col(role).alias("role"), F.col(frame).cast("long").alias("frame_idx"), F.col(time).cast("long").alias("timestamp_ms"), *SIGNALS, *[F.col(s).cast("double").alias(s) for s in state])
    joint = joint_scores(own.where("frame_idx is not null and timestamp_ms is not null"), "clip", "frame_idx", "timestamp_ms", state)
    line = joint.withColumns({"level": rolling_median(F.col("when"), ["clip"], "frame_idx"), "score": F.col("rank_sig")})
    found = segments(line, ["clip"], state, k=k, length_ms=length_ms, raw="when")

    given = {c: F.coalesce(c, F.lit(0.0)) for c in CHANNELS} | {"valence": 3 * F.greatest(F.coalesce("valence", F.lit(0.0)), F.lit(0.0))}
    most = F.greatest(*given.values())
    driver = reduce(lambda rest, c: F.when(given[c] == most, c).otherwise(rest), reversed(given), F.lit(None).cast("string"))
    drivers = F.struct(*[F.round(x, 2).alias(c) for c, x in given.items()])
    at = joint.select(F.col("clip").alias("__clip"), F.col("frame_idx").alias("__at"), drivers.alias("drivers"), driver.alias("driver"))
    told = found.join(at, F.col("clip").eqNullSafe(F.col("__clip")) & (F.col("peak_frame") == F.col("__at")))
    seg = F.struct("rank", F.col("peak_frame").alias("when_frame"), F.col("rep_frame").alias("peak_frame"), "start_ms", "end_ms", "resolved", "score", "drivers", "driver")
    listed = told.groupBy(F.col("clip").alias("__clip")).agg(F.array_sort(F.collect_list(seg)).alias("segs"))  # k at most
    clips = own.groupBy("clip").agg(F.coalesce(F.min(F.when(F.col("role") == "main", F.col("track"))), F.min("track")).alias("main_track"), F.count_distinct("track").alias("riders_joined"))
    out = clips.join(listed, F.col("clip").eqNullSafe(F.col("__clip")), "left").withColumn("segs", F.coalesce("segs", F.filter(F.array(F.lit(None).cast(listed.schema["segs"].dataType.elementType)), lambda x: x.isNotNull())))
    return out.select(F.col("clip").alias(clip), F.size("segs").alias("n_segs"), "segs", "main_track", "riders_joined")
