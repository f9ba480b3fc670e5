"""Grouped aggregates: supports, quantiles, tallies, merges, distributions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = Sequence[str]


def persistent(rows: DataFrame, subject: str, frame: str, share: float = 0.1) -> DataFrame:
    """subject, n: subjects seen in at least `share` of all different frames (one at least)."""
    total = rows.agg(F.greatest(F.floor(F.count_distinct(frame) * share), F.lit(1)).alias("__least"))
    counts = rows.groupBy(subject).agg(F.count_distinct(frame).alias("n"))
    return counts.join(F.broadcast(total), F.col("n") >= F.col("__least")).drop("__least")  # one row


def track_health(rows: DataFrame, keys: Keys, frame: str) -> DataFrame:
    """keys, n, first, last, gaps: different frames, and frames missing between the first and the last."""
    out = rows.groupBy(*keys).agg(F.count_distinct(frame).alias("n"), F.min(frame).alias("first"), F.max(frame).alias("last"))
    return out.withColumn("gaps", F.col("last") - F.col("first") + 1 - F.col("n"))


def cohort_median(x: Column, cohort: Column, keys: Keys) -> Column:
    """Median over the cohort's rows of the track, over all rows if it has none."""
    w = Window.partitionBy(*keys)
    return F.coalesce(F.median(F.when(cohort, x)).over(w), F.median(x).over(w))


def supported_median(x: Column, keys: Keys, least: int, part: float, otherwise: float) -> Column:
    """part * median of the track, `otherwise` where fewer than `least` values are present."""
    w = Window.partitionBy(*keys)
    return F.when(F.count(x).over(w) >= least, part * F.median(x).over(w)).otherwise(otherwise)


def share_of(test: Column) -> Column:
    """Share of rows for which the test holds; an unknown outcome counts as false."""
    return F.avg(F.coalesce(test, F.lit(False)).cast("int"))


def persistence_class(share: Column, worn: float = 0.5, low: float = 0.3, high: float = 0.7) -> Column:
    return F.when((share > low) & (share < high), "variable").when(share >= worn, "worn").otherwise("absent")


def quantile_baseline(rows: DataFrame, keys: Keys, x: str) -> DataFrame:
    """keys, n, p10 to p90, spread, positive, negative, strong: the track's quantiles and counts, strong being values of p75 or more."""
    w = Window.partitionBy(*keys)
    q = F.percentile(x, [0.1, 0.25, 0.5, 0.75, 0.9])
    at75 = rows.withColumn("__p75", F.percentile(x, 0.75).over(w))
    out = at75.groupBy(*keys).agg(
        F.count(x).alias("n"), q.alias("__q"), F.count_if(F.col(x) > 0).alias("positive"), F.count_if(F.col(x) < 0).alias("negative"), F.count_if(F.col(x) >= F.col("__p75")).alias("strong")
    )
    names = ["p10", "p25", "p50", "p75", "p90"]
    return out.select(*keys, "n", *[F.col("__q")[i].alias(p) for i, p in enumerate(names)], (F.col("__q")[4] - F.col("__q")[0]).alias("spread"), "positive", "negative", "strong")


def top_modes(rows: DataFrame, keys: Keys, label: str, order: str, k: int = 2) -> DataFrame:
    """keys, rank, label, n: the k most frequent labels; ties to the one seen first."""
    counts = rows.groupBy(*keys, label).agg(F.count("*").alias("n"), F.min(order).alias("__first"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "__first", label))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k).drop("__first")


def vote(rows: DataFrame, keys: Keys, first_wins: Column) -> DataFrame:
    """keys, a_votes, b_votes, winner ('a' on a tie), margin: a majority over rows; rows without an opinion do not vote."""
    out = rows.groupBy(*keys).agg(F.count_if(first_wins).alias("a_votes"), F.count_if(~first_wins).alias("b_votes"))
    total = F.nullif(F.col("a_votes") + F.col("b_votes"), F.lit(0))
    return out.withColumns({"winner": F.when(F.col("a_votes") >= F.col("b_votes"), "a").otherwise("b"), "margin": F.abs(F.col("a_votes") - F.col("b_votes")) / total})


def best_and_second(rows: DataFrame, keys: Keys, label: str, score: str) -> DataFrame:
    """keys, best, best_score, second_score, margin; ties to the lesser label."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), label))
    top = rows.withColumn("__r", rank).where(F.col("__r") <= 2)
    out = top.groupBy(*keys).agg(
        F.max(F.when(F.col("__r") == 1, F.col(label))).alias("best"), F.max(F.when(F.col("__r") == 1, F.col(score))).alias("best_score"), F.max(F.when(F.col("__r") == 2, F.col(score))).alias("second_score")
    )
    return out.withColumn("margin", F.col("best_score") - F.col("second_score"))


def merged_frames(rows: DataFrame, keys: Keys, greatest: Sequence[str]) -> DataFrame:
    """One row a frame over all riders: the greatest of each named signal."""
    return rows.groupBy(*keys).agg(*[F.max(c).alias(c) for c in greatest], F.count("*").alias("riders"))


def weighted_stats(x: Column, weight: Column) -> dict[str, Column]:
    """Weighted mean and population variance as aggregates."""
    w, wx, wxx = F.sum(weight), F.sum(weight * x), F.sum(weight * x * x)
    mean = wx / F.nullif(w, F.lit(0.0))
    return {"mean": mean, "variance": wxx / F.nullif(w, F.lit(0.0)) - mean * mean}


def entropy(rows: DataFrame, keys: Keys, x: str, bins: int, low: float, high: float) -> DataFrame:
    """keys, bits: entropy (base 2) of a histogram of x; values outside [low, high) are left out."""
    at = F.floor((F.col(x) - low) / (high - low) * bins)
    counts = rows.where((F.col(x) >= low) & (F.col(x) < high)).groupBy(*keys, at.alias("__bin")).agg(F.count("*").alias("__n"))
    share = F.col("__n") / F.sum("__n").over(Window.partitionBy(*keys))
    return counts.withColumn("__p", share).groupBy(*keys).agg((-F.sum(F.col("__p") * F.log2("__p"))).alias("bits"))


def latency_profile(rows: DataFrame, keys: Keys, modules: str) -> DataFrame:
    """keys, module, p50, p95, most over a map column of milliseconds; a row without a module counts 0 for it."""
    counted = rows.groupBy(*keys).agg(F.count("*").alias("__all"))
    each = rows.select(*keys, F.explode(modules).alias("module", "__ms")).withColumn("__w", F.lit(1).cast("long"))
    # rows without the module are one more value, 0, with their number as its weight
    present = each.groupBy(*keys, "module").agg(F.count("*").alias("__n")).join(counted, list(keys))
    zero = present.where("__all > __n").select(*keys, "module", F.lit(0.0).alias("__ms"), (F.col("__all") - F.col("__n")).alias("__w"))
    out = each.unionByName(zero).groupBy(*keys, "module").agg(F.percentile("__ms", [0.5, 0.95], F.col("__w")).alias("__q"), F.max("__ms").alias("most"))
    return out.select(*keys, "module", F.col("__q")[0].alias("p50"), F.col("__q")[1].alias("p95"), "most")


def robust_spread(x: str, least: int = 10) -> Column:
    """(p90 - p10) / |p50|, NULL with fewer than `least` values."""
    q = F.percentile(x, [0.1, 0.5, 0.9])
    return F.when(F.count(x) >= least, (q[2] - q[0]) / F.nullif(F.abs(q[1]), F.lit(0.0)))


def correlation(a: Column, b: Column) -> Column:
    """Pearson's correlation over rows with both values; NULL where one of them does not vary."""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.covar_pop(x, y) / F.when(spread > 0, spread)


def rank_correlation(rows: DataFrame, keys: Keys, a: str, b: str) -> DataFrame:
    """keys, rho: Spearman's correlation with average ranks."""

    def ranks(x: str) -> Column:
        w = Window.partitionBy(*keys).orderBy(x)
        return F.rank().over(w) + (F.count("*").over(Window.partitionBy(*keys, x)) - 1) / 2

    both = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumns({"__ra": ranks(a), "__rb": ranks(b)})
    return both.groupBy(*keys).agg(correlation(F.col("__ra"), F.col("__rb")).alias("rho"))


def distribution(rows: DataFrame, keys: Keys, x: str) -> DataFrame:
    """keys, n, mean, m2: a mergeable summary; NULLs are passed over."""
    return rows.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2"))


def merged_distributions(parts: DataFrame, keys: Keys) -> DataFrame:
    """The summary of the union of summarised sets: associative, with empty parts as identity."""
    n, mean = F.sum("n"), F.sum(F.col("n") * F.col("mean")) / F.nullif(F.sum("n"), F.lit(0))
    spread = F.sum("m2") + F.sum(F.col("n") * F.col("mean") * F.col("mean")) - n * mean * mean
    return parts.where("n > 0").groupBy(*keys).agg(n.alias("n"), mean.alias("mean"), spread.alias("m2"))


def label_means(rows: DataFrame, keys: Keys, labels: Mapping[str, Column]) -> DataFrame:
    """keys, winner, confidence and p_<label>: mean probabilities over sampled rows and the greatest; ties to the first label."""
    out = rows.groupBy(*keys).agg(*[F.avg(v).alias(f"p_{k}") for k, v in labels.items()])
    all_ = F.array(*[F.col(f"p_{k}") for k in labels])
    at = F.array_position(all_, F.array_max(all_)).cast("int")
    return out.withColumns({"winner": F.element_at(F.array(*[F.lit(k) for k in labels]), at), "confidence": F.array_max(all_)})
