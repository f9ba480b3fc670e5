"""Expressions over vector columns (arrays of doubles)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def normalised(a: Column) -> Column:
    size = norm(a)
    return F.transform(a, lambda x: x / F.nullif(size, F.lit(0.0)))


def mean_vector(rows: DataFrame, keys: list[str], vector: str, out: str, robust: bool = False, unit: bool = False) -> DataFrame:
    """Per group the entry-wise mean (or median) of a vector column; with `unit` of its vectors brought to length 1, which leaves those of length 0 no numbers.

    Entries are aggregated by position with map-side combine, so a group is never gathered. Medians are taken of counted values, which come by group: a task that
    met a few rows of each group would make a table of values for each of them.
    """
    if unit:  # a column of its own under the explosion, or each entry would take the length anew
        rows = rows.select(*keys, vector, norm(doubles(F.col(vector))).alias("__size"))
        entry = rows.select(*keys, "__size", F.posexplode(vector).alias("__at", "__x"))
        entry = entry.withColumn("__x", F.when(F.col("__size") != 0, F.col("__x") / F.col("__size")).otherwise(float("nan")))
    else:
        entry = rows.select(*keys, F.posexplode(vector).alias("__at", "__x"))
    if robust:
        entry = entry.groupBy(*keys, "__at", "__x").agg(F.count("*").alias("__n")).repartition(*keys, "__at")
    centre = F.percentile("__x", 0.5, F.col("__n")) if robust else F.avg("__x")
    by = entry.groupBy(*keys, "__at").agg(centre.alias("__x"))
    whole = by.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__at", "__x"))).alias("__all"))
    return whole.select(*keys, F.transform("__all", lambda s: s["__x"]).alias(out))
