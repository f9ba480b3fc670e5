"""Joins over frames, intervals and centroids."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.vectors import cosine

Keys = Sequence[str]


def frame_table(base: DataFrame, others: Sequence[DataFrame], keys: Keys) -> DataFrame:
    """base with the columns of every other table by the frame keys; absent rows give NULL. One exchange serves all of the joins."""
    return reduce(lambda a, b: a.join(b, list(keys), "left"), others, base)


def strictly_aligned(base: DataFrame, other: DataFrame, keys: Keys, frame: str, parts: int | None = None) -> DataFrame:
    """Left join, but a track of which one frame has no partner gets none at all. Rows are dealt over `parts` partitions (None: the session's)."""
    deal = lambda rows, *by: rows if parts is None else rows.repartition(parts, *by)
    joined = deal(deal(base, *keys, frame).join(deal(other.withColumn("__here", F.lit(True)), *keys, frame), [*keys, frame], "left"), *keys)
    lost = F.max(F.col("__here").isNull()).over(Window.partitionBy(*keys))
    added = [c for c in other.columns if c not in (*keys, frame)]
    joined = joined.withColumn("__lost", lost)
    return joined.withColumns({c: F.when(~F.col("__lost"), F.col(c)) for c in added}).drop("__here", "__lost")


def nearest_in_time(left: DataFrame, right: DataFrame, keys: Keys, at: str, value: str) -> DataFrame:
    """left with nearest_at and nearest: the row of `right` nearest in `at`, the earlier of two as near.

    Both sides go through one sorted window for each key, so no pair but the two neighbours is ever looked at.
    """
    a = left.withColumns({"__side": F.lit(1), "__hit": F.lit(None).cast(f"struct<at:{right.schema[at].dataType.simpleString()},value:{right.schema[value].dataType.simpleString()}>")})
    b = right.select(*keys, at, F.lit(0).alias("__side"), F.struct(F.col(at).alias("at"), F.col(value).alias("value")).alias("__hit"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(at, "__side")
    before = F.last("__hit", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("__hit", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    both = both.withColumns({"__b": before, "__a": after}).where("__side = 1")
    nearer = F.when(F.col("__b").isNull(), F.col("__a")).when(F.col("__a").isNull(), F.col("__b")).when(F.col("__a.at") - F.col(at) < F.col(at) - F.col("__b.at"), F.col("__a")).otherwise(F.col("__b"))
    return both.withColumn("__n", nearer).select(*left.columns, F.col("__n.at").alias("nearest_at"), F.col("__n.value").alias("nearest"))


def within(left: DataFrame, right: DataFrame, keys: Keys, a: str, b: str, tolerance: int) -> DataFrame:
    """All pairs of equal keys with |a - b| <= tolerance. Both sides are cut into cells of 2 * tolerance + 1, so a left row looks at two cells at most."""
    cell = 2 * tolerance + 1
    near = F.array_distinct(F.array(F.floor((F.col(a) - tolerance) / cell), F.floor((F.col(a) + tolerance) / cell)))
    probed = left.withColumn("__cell", F.explode(near))
    held = right.withColumn("__cell", F.floor(F.col(b) / cell))
    return probed.join(held, [*keys, "__cell"]).where(F.abs(F.col(a) - F.col(b)) <= tolerance).drop("__cell")


def in_intervals(points: DataFrame, intervals: DataFrame, keys: Keys, at: str, start: str, end: str, cell: int) -> DataFrame:
    """Points with each interval [start, end] of their key that holds them; intervals are entered in every cell they touch."""
    spread = intervals.withColumn("__cell", F.explode(F.sequence(F.floor(F.col(start) / cell), F.floor(F.col(end) / cell))))
    placed = points.withColumn("__cell", F.floor(F.col(at) / cell))
    return placed.join(spread, [*keys, "__cell"]).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("__cell")


def overlap(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Length of the common part of two intervals, 0 if none."""
    return F.greatest(F.least(end, other_end) - F.greatest(start, other_start), F.lit(0))


def together(rows: DataFrame, frame_keys: Keys, subject: str) -> DataFrame:
    """Frames with exactly two subjects: frame keys, a, b (a < b)."""
    found = rows.groupBy(*frame_keys).agg(F.count_distinct(subject).alias("__n"), F.min(subject).alias("a"), F.max(subject).alias("b"))
    return found.where("__n = 2").drop("__n")


def change_if_adjacent(vector: Column, keys: Keys, frame: str) -> Column:
    """Sum of absolute changes from the row before if that is the frame before, else NULL."""
    w = Window.partitionBy(*keys).orderBy(frame)
    before = F.lag(vector).over(w)
    change = F.aggregate(F.zip_with(vector, before, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.col(frame) - F.lag(frame).over(w) == 1, change)


def similar_pairs(centroids: DataFrame, keys: Keys, subject: str, vector: str, least: float, apart: DataFrame | None = None) -> DataFrame:
    """Pairs a < b of subjects of one group with cosine >= least; pairs listed in `apart` (keys, a, b), such as those seen together, are left out."""
    a = centroids.select(*keys, F.col(subject).alias("a"), F.col(vector).alias("__va"))
    b = centroids.select(*keys, F.col(subject).alias("b"), F.col(vector).alias("__vb"))
    pairs = a.join(b, list(keys)).where("a < b").withColumn("cos", cosine(F.col("__va"), F.col("__vb"))).where(F.col("cos") >= least).drop("__va", "__vb")
    return pairs if apart is None else pairs.join(apart, [*keys, "a", "b"], "left_anti")


def rival_similarity(rows: DataFrame, centroids: DataFrame, keys: Keys, subject: str, vector: str, centre: str, share: int = 20_000) -> DataFrame:
    """rows with cos_self and cos_other: cosine to the own centroid, and the greatest to another subject's of the same group; NULL where there is none.

    A group's rows are dealt in shares of about `share`, and its centroids go to each, so a group of any size is spread over tasks. In a share all
    cosines with vectors of one length are one product of two matrices; vectors of other lengths have no cosine, as null ones. A null group key is a group. Columns travel under numbers, so
    no name can clash, but for cos_self and cos_other, which are replaced.
    """
    rows = rows.drop("cos_self", "cos_other")
    names = [f"c{i}" for i in range(len(rows.columns))]
    own, at = rows.toDF(*names), dict(zip(rows.columns, names))
    groups = [f"k{i}" for i in range(len(keys))]
    same = lambda a, b: [F.col(f"a.{x}").eqNullSafe(F.col(f"b.{y}")) for x, y in zip(a, b)]
    parts = own.groupBy(*[F.col(at[k]).alias(g) for k, g in zip(keys, groups)]).agg(F.ceil(F.count("*") / share).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64(*[F.col(n) for n, f in zip(names, rows.schema.fields) if f.name != vector and not isinstance(f.dataType, T.MapType)]), F.col("parts")).cast("int")
    many = own.alias("a").join(parts.alias("b"), same([at[k] for k in keys], groups)).select(*[F.col(f"a.{n}").alias(n) for n in names], *groups, part.alias("part"))
    few = centroids.select(*[F.col(k).alias(g) for k, g in zip(keys, groups)], F.col(subject).alias("id"), F.col(centre).alias("v"))
    few = few.alias("a").join(parts.alias("b"), same(groups, groups)).select(*[F.col(f"a.{g}").alias(g) for g in groups], "id", "v", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    schema = T.StructType([*[T.StructField(n, f.dataType) for n, f in zip(names, rows.schema.fields)], T.StructField("cos_self", T.DoubleType()), T.StructField("cos_other", T.DoubleType())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        mine, other = np.full(left.num_rows, np.nan), np.full(left.num_rows, np.nan)
        vectors, centres = (t.column(c).combine_chunks() for t, c in ((left, at[vector]), (right, "v")))
        wide, held = (x.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) for x in (vectors, centres))
        ids = right.column("id").to_pylist()
        for width in np.intersect1d(wide[wide > 0], held).tolist():
            some, known = np.flatnonzero(wide == width), np.flatnonzero(held == width)
            place = {ids[i]: j for j, i in enumerate(known.tolist())}
            own_ = np.array([place.get(x, -1) for x in left.column(at[subject]).take(pa.array(some)).to_pylist()])
            near = _unit(vectors.take(pa.array(some))) @ _unit(centres.take(pa.array(known))).T
            has = np.flatnonzero(own_ >= 0)
            mine[some[has]] = near[has, own_[has]]
            near[has, own_[has]] = -np.inf
            best = np.where(np.isnan(near), -np.inf, near).max(1)
            other[some] = np.where(np.isfinite(best), best, np.nan)
        out = left.select(names)
        for name, x in (("cos_self", mine), ("cos_other", other)):
            out = out.append_column(name, pa.array(x, pa.float64(), from_pandas=True))
        return out

    found = many.groupBy(*groups, "part").cogroup(few.groupBy(*groups, "part")).applyInArrow(run, schema)
    return found.select(*[F.col(n).alias(c) for n, c in zip(names, rows.columns)], "cos_self", "cos_other")


def rivals_by_vector(rows: DataFrame, vectors: DataFrame, centroids: DataFrame, keys: Keys, subject: str, at: str, vector: str, centre: str, cells: int = 1, parts: int | None = None, groups: DataFrame | None = None) -> DataFrame:
    """rows without `at`, and with cos_self and cos_other as in rival_similarity, for rows that name their vector (`at`) in a table that few groups share.

    No row carries a vector. The table is cut into `cells` by its ids; each group's rows of a cell meet its vectors and the group's centroids in one task, so vectors travel once a group and
    centroids once a cell. Cosines are taken once for each vector and centroid of a group, whatever the number of rows. An id that is there twice has the greater cosines; one that is not there, or null, has
    none. Numbers that are none (a vector of length 0) stay so and count as greatest, as in SQL. Groups and cells are dealt over `parts` partitions (None: the session's).
    `groups` lists the keys of the groups, if that is cheaper than to take them from the centroids, which are made once more for it.
    """
    rows = rows.drop("cos_self", "cos_other")
    kept = [f for f in rows.schema.fields if f.name != at]
    named = [f"__k{i}" for i in range(len(keys))]  # the groups' keys, on their side
    deal = lambda df, *by: df if parts is None else df.repartition(parts, *by, "__cell")
    # rows that name no vector are nowhere to go to, so any cell will do
    cell = F.pmod(F.coalesce(F.when(F.col(at).isNotNull(), F.xxhash64(at)), F.xxhash64(*[f.name for f in kept if not isinstance(f.dataType, T.MapType)])), F.lit(cells)).cast("int").alias("__cell")
    left = deal(rows.select("*", cell), *keys)
    centroids = centroids.select(*[F.col(k).alias(x) for k, x in zip(keys, named)], F.col(subject).alias("__who"), F.col(centre).alias("__c")).where(F.col("__c").isNotNull())
    groups = F.broadcast((centroids.select(*named) if groups is None else groups.select(*[F.col(k).alias(x) for k, x in zip(keys, named)])).distinct())  # few
    held = vectors.select(F.col(at).cast(rows.schema[at].dataType).alias(at), F.col(vector).alias("__v")).where(F.col(at).isNotNull() & F.col("__v").isNotNull())
    held = held.crossJoin(groups).select(*named, F.pmod(F.xxhash64(at), F.lit(cells)).cast("int").alias("__cell"), F.col(at).alias("__at"), "__v")
    met = centroids.select(*named, F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("__cell"), "__who", "__c")
    right = deal(held.unionByName(met, allowMissingColumns=True), *named)
    schema = T.StructType([*kept, T.StructField("cos_self", T.DoubleType()), T.StructField("cos_other", T.DoubleType())])

    def run(some: pa.Table, right: pa.Table) -> pa.Table:
        one = lambda t, c: t.column(c).combine_chunks()
        table, centres = (right.filter(pc.is_valid(right.column(c))) for c in ("__v", "__c"))
        ids = one(table, "__at").dictionary_encode()
        place = lambda c, values: pc.fill_null(pc.index_in(one(some, c), value_set=values), -1).to_numpy(zero_copy_only=False)
        mine, other = _rivals(ids.indices.to_numpy(zero_copy_only=False), one(table, "__v"), one(centres, "__c"), place(at, ids.dictionary), place(subject, one(centres, "__who")))
        out = some.select([f.name for f in kept])
        for name, x in (("cos_self", mine), ("cos_other", other)):
            out = out.append_column(name, pa.array(x, pa.float64(), mask=np.isneginf(x)))
        return out

    return left.groupBy(*keys, "__cell").cogroup(right.groupBy(*named, "__cell")).applyInArrow(run, schema)


def _rivals(ids: np.ndarray, vectors: pa.ListArray, centres: pa.ListArray, at: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows with the vectors of id `at` and the own centroid `who` (-1: none), the cosine to it and the greatest to another; -inf: none."""
    mine, other = np.full(len(at), -np.inf), np.full(len(at), -np.inf)
    wide, held = (x.value_lengths().to_numpy(zero_copy_only=False) for x in (vectors, centres))
    for width in np.intersect1d(wide[wide > 0], held).tolist():
        some, known = np.flatnonzero(wide == width), np.flatnonzero(held == width)
        some = some[np.argsort(ids[some], kind="stable")]
        here, first = np.unique(ids[some], return_index=True)
        u, c = _unit(vectors.take(pa.array(some))), _unit(centres.take(pa.array(known))).T
        row, column = np.full(ids.max() + 2, -1), np.full(len(held) + 1, -1)  # the last for those that have none
        row[here], column[known] = np.arange(len(here)), np.arange(len(known))
        row, column = row[at], column[who]
        order = np.argsort(row, kind="stable")
        edges = row[order]
        step = max(1, 4_000_000 // len(known))  # numbers of a block
        for a in range(0, len(here), step):
            b = min(a + step, len(here))
            low, high = first[a], first[b] if b < len(here) else len(u)
            near = u[low:high] @ c
            if high - low > b - a:
                near = np.maximum.reduceat(near, first[a:b] - low, axis=0)
            these = order[slice(*np.searchsorted(edges, [a, b]))]
            i, j = row[these] - a, column[these]
            has = these[j >= 0]
            mine[has] = np.maximum(mine[has], near[i[j >= 0], j[j >= 0]])
            all_, best = np.arange(b - a), near.argmax(1)
            top = near[all_, best]
            near[all_, best] = -np.inf
            other[these] = np.maximum(other[these], np.where(best[i] == j, near.max(1)[i], top[i]))
    return mine, other


def _unit(vectors: pa.ListArray) -> np.ndarray:
    """Vectors of one length as rows of length 1; a null entry is no number."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.sqrt((x * x).sum(1, keepdims=True))


def sharing_frames(pairs: DataFrame, rows: DataFrame, keys: Keys, frame: str, subject: str) -> DataFrame:
    """pairs (keys, a, b) with `overlap`: whether the two subjects have a frame in common. Only the frames of the pairs named are looked at."""
    seen = rows.select(*keys, frame, subject).distinct()
    of_a = pairs.select(*keys, "a", "b").distinct().join(seen.withColumnRenamed(subject, "a"), [*keys, "a"])
    both = of_a.join(seen.withColumnRenamed(subject, "b"), [*keys, "b", frame], "left_semi").select(*keys, "a", "b").distinct()
    return pairs.join(both.withColumn("overlap", F.lit(True)), [*keys, "a", "b"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(False)))
