"""Scoring selections against people's labels and preferences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.joins import nearest_in_time, within


def against_labels(candidates: DataFrame, labels: DataFrame, keys: list[str], tolerance: int = 12, k: int = 3) -> DataFrame:
    """precision_at_1, hit_at_k, recall_at_k. candidates: keys, rank (from 1), frame_idx; labels: keys, label_frame, good (boolean).

    A candidate hits if a good label lies within `tolerance` frames. Only tracks that have labels count.
    """
    good = labels.where("good").select(*keys, "label_frame").distinct()
    near = within(candidates.where(F.col("rank") <= k), good, keys, "frame_idx", "label_frame", tolerance)
    hits = near.groupBy(*keys).agg(F.min("rank").alias("first_hit"), F.count_distinct("label_frame").alias("found"))
    asked = good.groupBy(*keys).agg(F.count("*").alias("wanted")).join(candidates.select(*keys).distinct(), keys, "left_semi").join(hits, keys, "left")
    return asked.agg(
        F.avg((F.coalesce("first_hit", F.lit(0)) == 1).cast("int")).alias("precision_at_1"), F.avg(F.col("first_hit").isNotNull().cast("int")).alias("hit_at_k"), (F.sum(F.coalesce("found", F.lit(0))) / F.sum("wanted")).alias("recall_at_k")
    )


def neighbour_pairs(ranked: DataFrame, keys: list[str], item: str) -> DataFrame:
    """keys, a, b: each item with the next in rank, the two sides swapped by a hash of both."""
    after = F.lead(item).over(Window.partitionBy(*keys).orderBy("rank"))
    pairs = ranked.select(*keys, F.col(item).alias("x"), after.alias("y")).where("y is not null")
    swap = F.substring(F.md5(F.concat_ws("/", F.col("x").cast("string"), F.col("y").cast("string"))), 1, 1) < "8"
    return pairs.select(*keys, F.when(swap, F.col("y")).otherwise(F.col("x")).alias("a"), F.when(swap, F.col("x")).otherwise(F.col("y")).alias("b"))


def random_windows(wanted: DataFrame, spans: DataFrame, ranges: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """wanted (keys, rank, start, end) with at: the start of a window as long, in the key's range, that touches none of the key's spans (start, end); rows without room have none.

    Starts run from `lo` to the last but one that fits before `hi` (ranges: keys, lo, hi). What the spans block is cut out of them, the gaps are numbered through, and a hash
    of seed, keys and rank takes one number, so nothing is drawn twice, every free start is as likely, and any partitioning gives the same windows.
    """
    own = [*keys, "rank"]
    base = wanted.select(*own, "start", "end", (F.col("end") - F.col("start")).alias("__n")).join(ranges, keys).withColumn("__stop", F.col("hi") - F.col("__n"))
    blocked = base.join(spans.select(*keys, F.col("start").alias("__a"), F.col("end").alias("__b")), keys)
    blocked = blocked.select(*own, "start", "end", "lo", "__stop", F.greatest(F.col("__a") - F.col("__n"), F.col("lo")).alias("__from"), F.col("__b").alias("__to")).where("__from < __stop and __to >= lo")
    last = base.select(*own, "start", "end", "lo", "__stop", F.col("__stop").alias("__from"), F.col("__stop").alias("__to"))
    w = Window.partitionBy(*own).orderBy("__from", "__to")
    free = F.coalesce(F.max("__to").over(w.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.col("lo"))
    gaps = blocked.unionByName(last).withColumn("__free", free).withColumn("__room", F.greatest(F.col("__from") - F.col("__free"), F.lit(0)))
    gaps = gaps.withColumns({"__upto": F.sum("__room").over(w.rowsBetween(Window.unboundedPreceding, 0)), "__all": F.sum("__room").over(Window.partitionBy(*own))})
    number = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), *[F.col(k).cast("string") for k in own])), 1, 8), 16, 10).cast("long")
    gaps = gaps.where(F.col("__all") > 0).withColumn("__pick", F.pmod(number, F.col("__all")))
    inside = (F.col("__pick") < F.col("__upto")) & (F.col("__pick") >= F.col("__upto") - F.col("__room"))
    return gaps.where(inside).select(*own, "start", "end", (F.col("__free") + F.col("__pick") - F.col("__upto") + F.col("__room")).alias("at"))


def segment_pairs(segments: DataFrame, ride: DataFrame, keys: list[str], frame: str, seed: int = 11, shift: int = 12, tried: int = 2) -> DataFrame:
    """keys, kind, a_start, a_end, b_start, b_end, system_pref: the pairs of segments that are put to a judge.

    segments: keys, rank (from 1), start, end in frames; ride: the frames a window may lie in. adjacent: each segment and the next in rank; random: each of the first `tried` and a
    window as long elsewhere; boundary: the first and itself `shift` frames later, if that is still within the ride. The system prefers the first of each; a hash swaps sides.
    """
    ranges = ride.groupBy(*keys).agg(F.min(frame).alias("lo"), F.max(frame).alias("hi"))
    w = Window.partitionBy(*keys).orderBy("rank")
    head = [*keys, "rank", "start", "end"]
    adjacent = segments.select(*head, F.lead("start").over(w).alias("other"), F.lead("end").over(w).alias("other_end")).where("other is not null").withColumn("kind", F.lit("adjacent"))
    chance = random_windows(segments.where(F.col("rank") <= tried), segments, ranges, keys, seed)
    chance = chance.select(*head, F.col("at").alias("other"), (F.col("at") + F.col("end") - F.col("start")).alias("other_end"), F.lit("random").alias("kind"))
    moved = segments.where("rank = 1").join(ranges, keys).where(F.col("end") + shift <= F.col("hi"))
    moved = moved.select(*head, (F.col("start") + shift).alias("other"), (F.col("end") + shift).alias("other_end"), F.lit("boundary").alias("kind"))
    named = F.concat_ws("/", F.lit(str(seed)), "kind", *[F.col(k).cast("string") for k in [*keys, "rank"]])
    both = adjacent.unionByName(chance).unionByName(moved).withColumn("__flip", F.substring(F.md5(named), 1, 1) < "8")
    side = lambda x, y: F.when(F.col("__flip"), F.col(y)).otherwise(F.col(x))
    return both.select(*keys, "kind", side("start", "other").alias("a_start"), side("end", "other_end").alias("a_end"), side("other", "start").alias("b_start"), side("other_end", "end").alias("b_end"), F.when(F.col("__flip"), "b").otherwise("a").alias("system_pref"))


def agreement(verdicts: DataFrame, lane: str) -> DataFrame:
    """lane, n, ties, agreement: the share of decided pairs in which the system's side won."""
    decided = F.col("winner").isin("a", "b")
    return verdicts.groupBy(lane).agg(F.count("*").alias("n"), F.count_if(F.col("winner") == "tie").alias("ties"), F.avg(F.when(decided, (F.col("winner") == F.col("system_pref")).cast("int"))).alias("agreement"))


def rescored(verdicts: DataFrame, scores: DataFrame, keys: list[str], frame: str, score: str) -> DataFrame:
    """verdicts with system_pref by present scores: b unless a scores more; pairs without both scores are left out."""
    a = scores.select(*keys, F.col(frame).alias("a_frame"), F.col(score).alias("__a"))
    b = scores.select(*keys, F.col(frame).alias("b_frame"), F.col(score).alias("__b"))
    both = verdicts.drop("system_pref").join(a, [*keys, "a_frame"]).join(b, [*keys, "b_frame"]).where("__a is not null and __b is not null")
    return both.withColumn("system_pref", F.when(F.col("__a") > F.col("__b"), "a").otherwise("b")).drop("__a", "__b")


def frame_at(labels: DataFrame, frames: DataFrame, keys: list[str], time: str, frame: str) -> DataFrame:
    """labels with the frame nearest in time."""
    return nearest_in_time(labels, frames, keys, time, frame)


def differences(old: DataFrame, new: DataFrame, keys: list[str], ignore: tuple[str, ...] = (), tolerance: float = 1e-6) -> DataFrame:
    """keys, field, old, new: where two runs differ. Numbers may differ by the tolerance, absolutely or in proportion; NaN equals NaN; absent rows differ."""
    fields = [c for c in old.columns if c not in keys and c not in ignore]
    x, y = old.select(*keys, *fields).alias("x").withColumn("__x", F.lit(True)), new.select(*keys, *fields).alias("y").withColumn("__y", F.lit(True))
    both = x.join(y, keys, "full")
    found = []
    for f in fields:
        p, q = F.col(f"x.{f}"), F.col(f"y.{f}")
        same = p.eqNullSafe(q)
        if old.schema[f].dataType.simpleString() in ("double", "float"):
            same = same | (F.isnan(p) & F.isnan(q)) | F.coalesce(F.abs(p - q) <= tolerance + tolerance * F.abs(p), F.lit(False))
        differs = ~same | F.col("__x").isNull() | F.col("__y").isNull()
        found.append(F.when(differs, F.struct(F.lit(f).alias("field"), p.cast("string").alias("old"), q.cast("string").alias("new"))))
    return both.select(*keys, F.explode(F.array_compact(F.array(*found))).alias("d")).select(*keys, "d.*")
