"""Constrained selection of rows per track."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = Sequence[str]


def greedy_separated(rows: DataFrame, keys: Keys, order: str, score: str, k: int, gap: int) -> DataFrame:
    """keys, pick (from 1), order, score: the best rows in turn, each at least `gap` from those before; ties to the lower order.

    `order` is a whole number, distinct within a track, so a pick rules out 2 * gap - 1 rows at most. All picks are then among the
    first (k - 1) * (2 * gap - 1) + 1 rows by score: a bounded list for each track, whatever its length.
    """
    bound = (k - 1) * max(1, 2 * gap - 1) + 1
    best = Window.partitionBy(*keys).orderBy(F.desc(score), order)
    top = rows.where(F.col(score).isNotNull()).select(*keys, order, score, F.row_number().over(best).alias("__n")).where(F.col("__n") <= bound)
    listed = top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__n", order, score))).alias("__all"))
    none = F.filter("__all", lambda x: F.lit(False))
    picked = F.aggregate("__all", none, lambda got, x: F.when((F.size(got) < k) & F.forall(got, lambda y: F.abs(y[order] - x[order]) >= gap), F.array_append(got, x)).otherwise(got))
    out = listed.select(*keys, F.posexplode(picked).alias("__at", "__one"))
    return out.select(*keys, (F.col("__at") + 1).alias("pick"), F.col(f"__one.{order}"), F.col(f"__one.{score}"))


def if_enough(picks: DataFrame, rows: DataFrame, keys: Keys, least: int) -> DataFrame:
    """Picks of the tracks that have at least `least` rows."""
    enough = rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select(*keys)
    return picks.join(enough, list(keys), "left_semi")


def best_per_bin(rows: DataFrame, keys: Keys, bin_: str, score: str, order: str, prefer: Column | None = None) -> DataFrame:
    """The best row of each bin: preferred rows first, then by score, then the lower order; a fallback only where a bin has no preferred row."""
    rank = F.struct((F.coalesce(prefer, F.lit(False)) if prefer is not None else F.lit(True)).alias("a"), F.col(score).alias("b"), (-F.col(order)).alias("c"))
    found = rows.where(F.col(score).isNotNull() & F.col(bin_).isNotNull()).groupBy(*keys, bin_).agg(F.max(rank).alias("__best"))
    return found.select(*keys, bin_, (-F.col("__best.c")).alias(order), F.col("__best.b").alias(score), F.col("__best.a").alias("preferred"))


def relaxed_top(rows: DataFrame, keys: Keys, order: str, score: str, rungs: Sequence[tuple[str, Column]], gaps: Sequence[int], k: int = 3) -> DataFrame:
    """keys, note, pick, order, score: the first rung, tried with each gap in turn, under which k rows can be chosen; else the last rung's choice.

    Rungs go from strict to loose. Each (rung, gap) is one bounded greedy choice; the first full one wins.
    """
    tried = None
    for i, (name, test) in enumerate(rungs):
        for j, gap in enumerate(gaps):
            own = greedy_separated(rows.where(F.coalesce(test, F.lit(False))), keys, order, score, k, gap)
            own = own.withColumns({"note": F.lit(name), "__step": F.lit(i * len(gaps) + j)})
            tried = own if tried is None else tried.unionByName(own)
    size = F.count("*").over(Window.partitionBy(*keys, "__step"))
    tried = tried.withColumn("__full", size >= k)
    last = len(rungs) * len(gaps) - 1
    chosen = F.coalesce(F.min(F.when(F.col("__full"), F.col("__step"))).over(Window.partitionBy(*keys)), F.lit(last))
    return tried.withColumn("__chosen", chosen).where("__step = __chosen").select(*keys, "note", "pick", order, score)


def every(rows: DataFrame, keys: Keys, order: str, stride: int) -> DataFrame:
    """The first row of each track and every stride-th after it."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    return rows.withColumn("__n", n).where(F.col("__n") % stride == 0).drop("__n")


def evenly_spaced(rows: DataFrame, keys: Keys, order: str, k: int) -> DataFrame:
    """k rows at the positions floor(i (n - 1) / (k - 1)); all rows of shorter tracks."""
    w = Window.partitionBy(*keys)
    rows = rows.withColumns({"__n": F.row_number().over(w.orderBy(order)) - 1, "__all": F.count("*").over(w)})
    i = F.ceil(F.col("__n") * (k - 1) / (F.col("__all") - 1))
    wanted = F.floor(i * (F.col("__all") - 1) / (k - 1)) == F.col("__n")
    return rows.where((F.col("__all") <= k) | (wanted & (i <= k - 1))).drop("__n", "__all")


def seeded(rows: DataFrame, keys: Keys, identity: str, seed: str, k: int) -> DataFrame:
    """k rows of each track in an order drawn by a hash of seed and identity: the same on any cluster and partitioning."""
    draw = F.md5(F.concat_ws("/", F.lit(seed), F.col(identity).cast("string")))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(draw, identity))
    return rows.withColumn("draw", n).where(F.col("draw") <= k)


def top_entries(values: Mapping[str, Column], n: int, by_size: bool = False) -> Column:
    """The n greatest (name, value) of a set of columns, by value or by absolute value; ties by name, NULLs left out."""
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("name"), v.alias("value")) for k, v in values.items()]), lambda x: x["value"].isNotNull())
    weight = (lambda x: F.abs(x["value"])) if by_size else (lambda x: x["value"])
    order = lambda a, b: F.when(weight(a) > weight(b), -1).when(weight(a) < weight(b), 1).when(a["name"] < b["name"], -1).otherwise(1)
    return F.slice(F.array_sort(entries, order), 1, n)


def with_support(rows: DataFrame, keys: Keys, cohort: Column, least: int) -> DataFrame:
    """Rows of the cohort in tracks where it has `least` rows; all rows of other tracks."""
    on = F.coalesce(cohort, F.lit(False))
    return rows.withColumn("__n", F.count(F.when(on, 1)).over(Window.partitionBy(*keys))).where(on | (F.col("__n") < least)).drop("__n")
