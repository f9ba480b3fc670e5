"""Features by the port, and whole records of clips."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.operators.windows import robust_z
from tracewell.plans import readings, scores
from tracewell.plans.highlights import clip_highlights
from tracewell.queries.book import Book, frames, table
from tracewell.sources import port

BOOK = Book()


class Shipping:
    """Three signals of a line item, the second of which is missing in every fourth line."""

    name, feature_space, dim, columns = "tracewell_shipping", "shipping3d", 3, ("l_quantity", "l_discount", "l_tax", "l_linenumber")

    def extract(self, frames: pa.Table) -> np.ndarray:
        quantity, discount, tax, line = (frames.column(c).to_numpy() for c in self.columns)
        return np.stack([quantity / 50, np.where(line % 4 == 0, np.nan, discount * 10), tax * 10], 1)


@BOOK.add("s17_port", "SELECT l_returnflag AS clip_id, l_suppkey AS track_id, l_orderkey AS frame_idx, 'shipping3d' AS feature_space, round(l_quantity / 50, 6) AS a, round(CASE WHEN l_linenumber % 4 <> 0 THEN l_discount * 10 END, 6) AS b, round(l_tax * 10, 6) AS c FROM lineitem WHERE l_suppkey IS NOT NULL AND l_orderkey IS NOT NULL")
def s17(spark: SparkSession, d: str) -> DataFrame:
    """All lines through the data source; that places are known is tested there."""
    read = spark.read.format(port.register(spark, Shipping())).options(clip="l_returnflag", track="l_suppkey", frame="l_orderkey").load(f"{d}/lineitem.parquet")
    own = read.where("track_id is not null and frame_idx is not null")
    return own.select("clip_id", "track_id", "frame_idx", "feature_space", *[F.round(F.col("features")[i], 6).alias(n) for i, n in enumerate("abc")])


def moments(spark: SparkSession, d: str) -> DataFrame:
    """events as scored frames: four users share a clip, the second of whom is its main rider."""
    rows = frames(spark, d).withColumn("y", F.col("k").cast("double"))
    rows = robust_z(robust_z(rows, "value", ["track_id"], "a"), "y", ["track_id"], "b")
    made = {
        "impact": F.greatest("a", F.lit(0.0)), "rarity": F.when(F.col("k") % 7 != 0, F.abs("b")), "scene": F.when(F.col("k") % 3 == 0, F.col("k") / 30), "valence": F.when(F.col("k") % 5 != 0, F.col("value") / 50 - 0.6), "arousal": F.abs("b") / 2,
        "clip_id": F.floor(F.col("track_id") / 4), "role": F.when(F.col("track_id") % 4 == 1, "main").otherwise("guest"), "timestamp_ms": F.col("frame_idx") * 500,
    }
    rows = rows.withColumns(made)
    rows = rows.withColumns({"when": scores.when(*[F.col(c) for c in ("impact", "rarity", "scene", "valence")]), "which": F.when(F.col("k") % 11 != 0, F.col("y") / 100)})
    return rows.withColumn("rank_sig", F.col("when") * F.col("which"))


@BOOK.add("q04_segments")
def q04_segments(spark: SparkSession, d: str) -> DataFrame:
    """The records of all clips, one row a segment and one for a clip without any. Its rules go in turn, so tests hold it against a plain account."""
    found = clip_highlights(moments(spark, d), "clip_id", "track_id", "role", "frame_idx", "timestamp_ms", ["a", "b"])
    return found.select("clip_id", "n_segs", "main_track", "riders_joined", F.explode_outer("segs").alias("s")).select("clip_id", "n_segs", "main_track", "riders_joined", "s.*").select("*", "drivers.*").drop("drivers")


# fixed values: the axes that a recipe may fill; nothing here measures the last one
_REGISTRY = (("a1", "size", "cont", 0.0, 40.0), ("a2", "price", "cont", 900.0, 1500.0), ("a3", "brand", "cat", None, None), ("a4", "tilt", "cont", -45.0, 45.0))
_AXES = "('a1', 'size', 'cont', 0.0::DOUBLE, 40.0::DOUBLE), ('a2', 'price', 'cont', 900.0, 1500.0), ('a3', 'brand', 'cat', NULL, NULL), ('a4', 'tilt', 'cont', -45.0, 45.0)"


@BOOK.add("q07_recipe", f"""WITH r(axis_id, name, type, lo, hi) AS (VALUES {_AXES}), m AS (SELECT p_partkey, unnest(['size', 'price', 'brand']) AS name, unnest([CASE WHEN p_size % 5 <> 0 THEN round(p_size / 7.0::DOUBLE, 6) END, round(p_retailprice, 6), NULL]) AS value_num, unnest([NULL, NULL, CASE WHEN p_size % 3 <> 0 THEN p_brand END]) AS value_cat FROM part),
    f AS (SELECT p_partkey, axis_id, r.name, type, value_num, value_cat, lo, hi FROM m JOIN r ON r.name = m.name WHERE value_num IS NOT NULL OR value_cat IS NOT NULL)
    SELECT p_partkey, axis_id, name, type, value_num, value_cat, value_num BETWEEN lo AND hi AS within FROM f UNION ALL SELECT p_partkey, axis_id, NULL, 'unfilled', NULL, NULL, NULL FROM part, r WHERE (p_partkey, axis_id) NOT IN (SELECT (p_partkey, axis_id) FROM f)""")
def q07(spark: SparkSession, d: str) -> DataFrame:
    """The recipe of every part: measured axes with whether they lie in the axis' range, and those that nothing fills."""
    axes = F.struct(F.when(F.col("p_size") % 5 != 0, F.col("p_size") / F.lit(7.0)).alias("size"), F.col("p_retailprice").cast("double").alias("price"), F.when(F.col("p_size") % 3 != 0, F.col("p_brand")).alias("brand"))
    registry = spark.createDataFrame(_REGISTRY, "axis_id string, name string, type string, lo double, hi double")
    filled, unfilled = readings.recipe(table(spark, d, "part").select("p_partkey", axes.alias("axes")), "p_partkey", "axes", registry)
    told = filled.select("p_partkey", "axis_id", "name", "type", "value_num", "value_cat", F.col("value_num").between(F.col("lo"), F.col("hi")).alias("within"))
    nothing = {"name": "string", "value_num": "double", "value_cat": "string", "within": "boolean"}
    return told.unionByName(unfilled.withColumns({c: F.lit(None).cast(t) for c, t in nothing.items()} | {"type": F.lit("unfilled")}))


@BOOK.add("q08_by_reply", """WITH c AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS place FROM lineitem),
    s AS (SELECT l_orderkey, CAST(place AS INTEGER) AS place, coalesce(CASE place WHEN 1 THEN least(10.0, CAST(o_orderkey % 13 AS DOUBLE)) WHEN 2 THEN CAST((o_custkey % 7) || '.5' AS DOUBLE) END, 0) AS language_score FROM c LEFT JOIN orders ON o_orderkey = l_orderkey)
    SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY language_score DESC, place) AS INTEGER) AS rank FROM s""")
def q08(spark: SparkSession, d: str) -> DataFrame:
    """The candidates of every order (its lines, numbered anew) ranked by what a reply, one text an order, says of them."""
    text = F.concat(F.lit("1: "), F.col("o_orderkey") % 13, F.lit("\nnone\n 2) "), F.col("o_custkey") % 7, F.lit(".5"))
    replies = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), text.alias("reply"))
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    return scores.ranked_by_reply(table(spark, d, "lineitem").select("l_orderkey", place.alias("place")), replies, "l_orderkey", "place")
