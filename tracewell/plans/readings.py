"""Per-track readings: emotion baselines, identity, worn things, recipes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.numbers import balanced_pair, clip, unit
from tracewell.functions.vectors import cosine, doubles, mean_vector, normalised
from tracewell.operators.aggregates import correlation, persistence_class, quantile_baseline, share_of, top_modes
from tracewell.operators.selection import with_support


def emotion_baseline(rows: DataFrame, keys: Sequence[str], frame: str, riding: Column, label: str, x: str = "valence", least: int = 30) -> DataFrame:
    """The quantile baseline of ride frames (all frames in tracks with fewer than `least`), and the two most frequent labels in either tail."""
    own = with_support(rows.where(F.col(x).isNotNull()), keys, riding, least)
    base = quantile_baseline(own, keys, x)
    edged = own.join(base.select(*keys, "p10", "p90"), list(keys))
    high = top_modes(edged.where(F.col(x) >= F.col("p90")), keys, label, frame).groupBy(*keys).agg(F.max(F.when(F.col("rank") == 1, F.col(label))).alias("high_label"))
    low = top_modes(edged.where(F.col(x) <= F.col("p10")), keys, label, frame).groupBy(*keys).agg(F.max(F.when(F.col("rank") == 1, F.col(label))).alias("low_label"))
    return base.join(high, list(keys), "left").join(low, list(keys), "left")


def anomaly(rows: DataFrame, baseline: DataFrame, keys: Sequence[str], x: str = "valence") -> DataFrame:
    """rows with anomaly = |x - p50|."""
    return rows.join(baseline.select(*keys, "p50"), list(keys), "left").withColumn("anomaly", F.abs(F.col(x) - F.col("p50"))).drop("p50")


def identity(rows: DataFrame, keys: Sequence[str], embedding: str, cohort: Column, least: int = 10) -> DataFrame:
    """keys, n, coherence, coherence_p05, low_confidence: how alike the cohort's embeddings are to their mean direction; all rows where the cohort is small."""
    own = with_support(rows.where(F.col(embedding).isNotNull()), keys, cohort, least).withColumn("__v", normalised(doubles(F.col(embedding))))
    centre = mean_vector(own, list(keys), "__v", "__c")
    near = own.join(centre, list(keys)).withColumn("__cos", cosine(F.col("__v"), F.col("__c")))
    out = near.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("__cos").alias("coherence"), F.percentile("__cos", 0.05).alias("coherence_p05"))
    return out.withColumn("low_confidence", F.col("coherence") < 0.5)


def identity_deviation(rows: DataFrame, keys: Sequence[str], embedding: str) -> DataFrame:
    """rows with iddev = 1 - cosine to the track's centre."""
    own = rows.withColumn("__v", normalised(doubles(F.col(embedding))))
    return own.join(mean_vector(own, list(keys), "__v", "__c"), list(keys), "left").withColumn("iddev", 1 - cosine(F.col("__v"), F.col("__c"))).drop("__v", "__c")


def worn(rows: DataFrame, keys: Sequence[str], tests: Mapping[str, Column]) -> DataFrame:
    """keys, then for each thing its share of frames and whether it is worn, variable or absent."""
    out = rows.groupBy(*keys).agg(*[share_of(test).alias(f"{name}_share") for name, test in tests.items()])
    return out.withColumns({name: persistence_class(F.col(f"{name}_share")) for name in tests})


def top_dimensions(rows: DataFrame, keys: Sequence[str], vector: str, names: Sequence[str], k: int = 5) -> DataFrame:
    """keys, rank, name, median, p90: the k dimensions of greatest median."""
    entry = rows.select(*keys, F.posexplode(doubles(F.col(vector))).alias("at", "x")).where(F.col("at") < len(names))
    by = entry.groupBy(*keys, "at").agg(F.median("x").alias("median"), F.percentile("x", 0.9).alias("p90"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("median"), "at"))
    named = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("at") + 1)
    return by.withColumn("rank", rank).where(F.col("rank") <= k).select(*keys, "rank", named.alias("name"), "median", "p90")


def separation(centres: DataFrame, clip_: str, subject: str, centre: str, drift: str) -> DataFrame:
    """clip, a, b, gap, ratio: the root mean square distance between subjects' shapes, and in proportion to how much each drifts."""
    a = centres.select(clip_, F.col(subject).alias("a"), F.col(centre).alias("__ca"), F.col(drift).alias("__da"))
    b = centres.select(clip_, F.col(subject).alias("b"), F.col(centre).alias("__cb"), F.col(drift).alias("__db"))
    pair = a.join(b, clip_).where("a < b")
    square = F.aggregate(F.zip_with("__ca", "__cb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    gap = F.sqrt(square / F.size("__ca"))
    return pair.select(clip_, "a", "b", gap.alias("gap"), (gap / F.nullif((F.col("__da") + F.col("__db")) / 2, F.lit(0.0))).alias("ratio"))


def shape_keys(axes: DataFrame, mapping: DataFrame, image: str = "image_id", gain: float = 1.0) -> DataFrame:
    """image, shape_key, value. axes: image, axis_id, value_num, lo, hi; mapping: shape_key, axis_id, flip: one axis, or two that balance each other."""
    reading = axes.join(F.broadcast(mapping), "axis_id")  # the mapping is a fixed table of tens of rows
    value = unit(F.col("value_num"), F.col("lo"), F.col("hi"))
    reading = reading.withColumn("__v", F.when(F.col("flip"), 1 - value).otherwise(value))
    pair = reading.groupBy(image, "shape_key").agg(F.min_by("__v", "axis_id").alias("__a"), F.max_by("__v", "axis_id").alias("__b"))
    return pair.select(image, "shape_key", clip(0.5 + gain * (balanced_pair(F.col("__a"), F.col("__b")) - 0.5), 0.0, 1.0).alias("value"))


def matched(subjects: DataFrame, library: DataFrame, name: str, subject: str, weights: Mapping[str, float]) -> DataFrame:
    """subject, name, score: the library entry whose attributes agree best by weight; none where nothing agrees. The library is a fixed table of tens of rows.

    Attributes are compared one by one through a join on (attribute, value), so subjects are not paired with entries that share nothing.
    """
    def long(df: DataFrame, key: str) -> DataFrame:
        return df.select(key, F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value"), F.lit(w).alias("weight")) for a, w in weights.items()])).alias("e")).select(key, "e.*")

    hits = long(subjects, subject).join(F.broadcast(long(library, name).drop("weight")), ["attribute", "value"])
    total = hits.groupBy(subject, name).agg(F.sum("weight").alias("score"))
    rank = F.row_number().over(Window.partitionBy(subject).orderBy(F.desc("score"), name))
    return total.withColumn("__r", rank).where("__r = 1 and score > 0").drop("__r")


def recipe(rows: DataFrame, image: str, axes: str, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(image, axis_id, name, type, value_num, value_cat, lo, hi) for every measured axis, and (image, axis_id) of the registry's axes that no value fills.

    axes: a struct of measures; registry: axis_id, name, type (cont or cat), lo, hi, a fixed table of tens of rows. Numbers are rounded to 6 places.
    """
    fields = rows.schema[axes].dataType.fields
    entry = F.array(*[F.struct(F.lit(f.name).alias("name"), F.col(f"{axes}.{f.name}").cast("string").alias("value")) for f in fields])
    long = rows.select(image, F.explode(entry).alias("e")).select(image, "e.*").where("value is not null")
    known = long.join(F.broadcast(registry), "name")
    number = F.when(F.col("type") == "cont", F.round(F.col("value").cast("double"), 6))
    filled = known.select(image, "axis_id", "name", "type", number.alias("value_num"), F.when(F.col("type") == "cat", F.col("value")).alias("value_cat"), "lo", "hi")
    wanted = rows.select(image, F.explode(registry_ids(registry)).alias("axis_id"))
    return filled, wanted.join(filled.select(image, "axis_id"), [image, "axis_id"], "left_anti")


def registry_ids(registry: DataFrame) -> Column:
    """The ids of a fixed registry as an array literal."""
    return F.array(*[F.lit(r["axis_id"]) for r in registry.select("axis_id").collect()])


def component_probes(scores: DataFrame, keys: Sequence[str], components: Sequence[str], probes: Sequence[str], k: int = 2, least: int = 10) -> DataFrame:
    """keys, component, rank, probe, corr: the k probes that each component goes with most, by absolute correlation; tracks of `least` rows or fewer, and signals
    without spread, are left out."""
    found = []
    for c in components:
        for q in probes:
            steady = (F.stddev_pop(c) > 1e-9) & (F.stddev_pop(q) > 1e-9) & (F.count(F.col(c) + F.col(q)) > least)
            found.append(F.struct(F.lit(c).alias("component"), F.lit(q).alias("probe"), F.when(steady, correlation(F.col(c), F.col(q))).alias("corr")))
    each = scores.groupBy(*keys).agg(F.array(*found).alias("all")).select(*keys, F.explode("all").alias("e")).select(*keys, "e.*").where("corr is not null")
    rank = F.row_number().over(Window.partitionBy(*keys, "component").orderBy(F.desc(F.abs("corr")), "probe"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k)
