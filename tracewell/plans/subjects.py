"""From detections to subjects: stitching tracks, roles by vote, phases, tubelets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.vectors import cosine, doubles, mean_vector
from tracewell.operators.aggregates import persistent, vote
from tracewell.operators.joins import similar_pairs, together
from tracewell.operators.windows import boxcar, first_sustained, row_runs
from tracewell.sources.checkpoints import cut


def seen_together(rows: DataFrame, clip: str, frame: str, track: str) -> DataFrame:
    """clip, a, b (a < b): tracks that share a frame. A frame holds a handful of tracks."""
    a = rows.select(clip, frame, F.col(track).alias("a")).distinct()
    return a.join(a.withColumnRenamed("a", "b"), [clip, frame]).where("a < b").select(clip, "a", "b").distinct()


def stitched(rows: DataFrame, clip: str, frame: str, track: str, embedding: str, least: float = 0.5) -> DataFrame:
    """clip, track, subject: tracks of one clip whose mean embeddings are alike and that never share a frame are one subject, named by the least of its tracks.

    A label spreads along links until nothing changes; clips do not meet, so the rounds follow the longest chain of tracks in a clip.
    """
    centres = mean_vector(rows.where(F.col(embedding).isNotNull()).withColumn("__e", doubles(F.col(embedding))), [clip, track], "__e", "centre")
    links = cut(similar_pairs(centres, [clip], track, "centre", least, seen_together(rows, clip, frame, track)).select(clip, "a", "b"))
    both = links.unionByName(links.select(clip, F.col("b").alias("a"), F.col("a").alias("b")))
    label = cut(rows.select(clip, F.col(track).alias("a"), F.col(track).alias("subject")).distinct())
    while True:
        near = both.join(label.select(clip, F.col("a").alias("b"), F.col("subject").alias("__s")), [clip, "b"]).groupBy(clip, "a").agg(F.min("__s").alias("__s"))
        moved = cut(label.join(near, [clip, "a"], "left").select(clip, "a", F.least("subject", "__s").alias("subject"), (F.col("__s") < F.col("subject")).alias("__moved")))
        label = moved.drop("__moved")
        if moved.where("__moved").isEmpty():
            return label.withColumnRenamed("a", track)


def purity(rows: DataFrame, clip: str, subject: str, frame: str, embedding: str, low: float = 0.4, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """(clip, subject, n, mean_cos, min_cos, p05_cos), and the runs of frames unlike their subject's centre."""
    own = rows.where(F.col(embedding).isNotNull()).withColumn("__e", doubles(F.col(embedding)))
    near = own.join(mean_vector(own, [clip, subject], "__e", "__c"), [clip, subject]).withColumn("cos", cosine(F.col("__e"), F.col("__c")))
    summary = near.groupBy(clip, subject).agg(F.count("*").alias("n"), F.avg("cos").alias("mean_cos"), F.min("cos").alias("min_cos"), F.percentile("cos", 0.05).alias("p05_cos"))
    return summary, row_runs(near, F.col("cos") < low, [clip, subject], frame, least)


def main_rider(rows: DataFrame, clip: str, frame: str, subject: str, depth: str, stride: int = 5) -> DataFrame:
    """clip, a, b, a_votes, b_votes, winner, margin: of two subjects seen together, who is nearer in every stride-th common frame."""
    pairs = together(rows, [clip, frame], subject)
    nth = F.row_number().over(Window.partitionBy(clip, "a", "b").orderBy(frame)) - 1
    sampled = pairs.withColumn("__n", nth).where(F.col("__n") % stride == 0).drop("__n")
    of = lambda name: rows.select(clip, frame, F.col(subject).alias(name), F.col(depth).alias(f"__{name}"))
    seen = sampled.join(of("a"), [clip, frame, "a"]).join(of("b"), [clip, frame, "b"])
    return vote(seen, [clip, "a", "b"], F.col("__a") <= F.col("__b"))


def ride_phase(motion: DataFrame, clip: str, frame: str, x: str, level: float, smooth: int = 12, hold: int = 6) -> DataFrame:
    """motion with scene_phase: ride from the frame at which smoothed motion first stays at `level` for `hold` rows, boarding before; no such frame: ride."""
    smoothed = motion.withColumn("__s", boxcar(F.col(x), [clip], frame, smooth))
    start = first_sustained(smoothed, F.col("__s") >= level, [clip], frame, hold)
    joined = smoothed.join(start, clip, "left")
    return joined.withColumn("scene_phase", F.when(F.col(frame) < F.col("start"), "boarding").otherwise("ride")).drop("__s", "start")


def tubelets(rows: DataFrame, subjects: DataFrame, roles: DataFrame, phases: DataFrame, clip: str, frame: str, track: str, fps: float = 30.0) -> DataFrame:
    """Detections with subject, role, phase and time; subjects without a role, or never in the ride, are left out; unknown phases are ride."""
    named = rows.join(subjects, [clip, track]).join(roles, [clip, "subject"])
    timed = named.join(phases.select(clip, frame, "scene_phase"), [clip, frame], "left").withColumn("scene_phase", F.coalesce("scene_phase", F.lit("ride")))
    riding = F.max((F.col("scene_phase") == "ride").cast("int")).over(Window.partitionBy(clip, "subject"))
    return timed.withColumns({"timestamp_ms": F.bround(F.col(frame) / fps * 1000).cast("long"), "__r": riding}).where("__r = 1").drop("__r")


def subjects_that_last(rows: DataFrame, subject: str, frame: str) -> DataFrame:
    return persistent(rows, subject, frame)
