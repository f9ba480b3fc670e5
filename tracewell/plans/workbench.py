"""The workbench's wide table of a clip's main rider, and the frames picked from it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.numbers import passes
from tracewell.functions.vectors import dot, doubles, mean_vector, norm, normalised
from tracewell.operators.alignment import aligned
from tracewell.operators.selection import greedy_separated
from tracewell.operators.windows import unit_rank
from tracewell.plans.scores import state_blends


def direction_readings(detections: DataFrame, keys: Sequence[str], frame: str, vector: str, least: int = 10) -> DataFrame:
    """keys, frame, size, coherence: an embedding's length, and its cosine to the entry-wise median of the track's unit embeddings; both NULL in tracks of fewer than `least` embeddings."""
    known = detections.where(F.col(vector).isNotNull()).select(*keys, frame, doubles(F.col(vector)).alias("__v")).withColumn("__u", normalised(F.col("__v")))
    centre = mean_vector(known, list(keys), "__u", "__c", robust=True)
    enough = known.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select(*keys)
    centre = centre.join(enough, list(keys)).withColumn("__c", normalised(F.col("__c")))
    joined = known.join(centre, list(keys), "left")
    return joined.select(*keys, frame, F.when(F.col("__c").isNotNull(), norm(F.col("__v"))).alias("size"), dot(F.col("__u"), F.col("__c")).alias("coherence"))


def main_rider_frames(
    riders: DataFrame, landmarks: DataFrame, gate: DataFrame, features: DataFrame, parse: DataFrame, detections: DataFrame, tubelets: DataFrame, clip: str = "clip_id", track: str = "track_id", frame: str = "frame_idx", least: int = 10
) -> DataFrame:
    """One row a landmark frame of each clip's main rider: the columns of landmarks, features and parse, lum_eff (light without what is burnt out), size and coherence of the
    embedding, board (whether in the boarding phase).

    riders: clip, track, role; gate: valid; parse: lum and chi among others; detections: embedding; tubelets: scene_phase. Frames that are not valid go, unless fewer
    than `least` of the rider's would be left. What a source lacks is NULL (board: false). Sources meet in one exchange; the riders' filter and the count of
    valid frames come after it, over the main riders' rows only.
    """
    keys = [clip, track]
    directions = direction_readings(detections, keys, frame, "embedding")
    sources = {"landmarks": landmarks, "gate": gate, "features": features, "parse": parse, "detections": directions, "tubelets": tubelets}
    whole = aligned(sources, [*keys, frame], "landmarks")
    main = whole.join(riders.where("role = 'main'").select(*keys).distinct(), keys, "left_semi")
    valid = F.coalesce("gate.valid", F.lit(False))
    kept = main.withColumn("__n", F.count_if(valid).over(Window.partitionBy(*keys))).where(valid | (F.col("__n") < least))
    plain = [F.col(f"{s}.{f.name}") for s in ("landmarks", "features", "parse") for f in whole.schema[s].dataType.fields]
    light = F.col("parse.lum") * (1 - F.coalesce("parse.chi", F.lit(0.0)))
    return kept.select(*keys, frame, *plain, light.alias("lum_eff"), "detections.size", "detections.coherence", F.coalesce(F.col("tubelets.scene_phase") == "boarding", F.lit(False)).alias("board"))


def picked(wide: DataFrame, keys: Sequence[str], frame: str, screens: Mapping[str, tuple[float | None, float | None]], weights: Mapping[str, float], gap: int = 12, k: int = 3, places: int = 9) -> DataFrame:
    """keys, pick, frame, score: the k best frames that pass the screens, `gap` apart.

    The score weighs the blends of state_blends() over unit ranks within the track: stillness (expr, low is high), pupil, blur, micro, size, coherence, mv, lum_eff. Ranks are
    taken over all frames, a missing value ranking lowest; a missing value passes its screen.
    """
    def rank(name: str, flip: bool = False) -> Column:
        return unit_rank(F.coalesce(name, F.lit(float("inf" if flip else "-inf"))), list(keys), frame, flip)

    blends = state_blends([rank("expr", True), *[rank(n) for n in ("pupil", "blur", "micro", "size", "coherence", "mv", "lum_eff")]])
    score = sum((F.lit(w) * blends[name] for name, w in weights.items()), F.lit(0.0))
    scored = wide.withColumn("score", F.round(score, places)).where(passes(screens))
    return greedy_separated(scored, list(keys), frame, "score", k, gap)
