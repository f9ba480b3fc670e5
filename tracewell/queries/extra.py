"""Readings of vectors as named columns, drift between halves of a track, and overlap of frame sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import numbers as N
from tracewell.functions.vectors import distance, mean_vector
from tracewell.operators import joins as J
from tracewell.operators import windows as W
from tracewell.queries.book import CENTRES, VECTORS, Book, table, vectors

BOOK = Book()


@BOOK.add("f01_f02_named_dims", f"WITH {VECTORS} SELECT frame_idx, round(v[1], 6) AS smile, round(v[2], 6) AS jaw, round(v[64], 6) AS blink FROM e WHERE subject = 3")
def f01(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("v")
    own = vectors(spark, d).where("subject = 3")
    return own.select("frame_idx", *[F.round(N.dim(v, i), 6).alias(name) for name, i in (("smile", 0), ("jaw", 1), ("blink", 63))])


@BOOK.add("f11_neutral_distance", f"WITH {VECTORS}, {CENTRES} SELECT e.subject, frame_idx, round(list_distance(v, c), 5) AS apart FROM e JOIN c ON c.subject = e.subject")
def f11(spark: SparkSession, d: str) -> DataFrame:
    own = vectors(spark, d)
    return own.join(mean_vector(own, ["subject"], "v", "c"), "subject").select("subject", "frame_idx", F.round(distance(F.col("v"), F.col("c")), 5).alias("apart"))


@BOOK.add("f34_angle_interval", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_partkey % 360 >= 300 OR l_partkey % 360 <= 20")
def f34(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").where(N.in_arc(F.col("l_partkey") % 360, 300, 20)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@BOOK.add("a15_split_half_drift", f"""WITH {VECTORS}, r AS (SELECT *, count(*) OVER (PARTITION BY subject) AS n, row_number() OVER (PARTITION BY subject ORDER BY frame_idx) AS i FROM e),
    x AS (SELECT subject, n, i <= n // 2 AS first, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM r),
    m AS (SELECT subject, n, pos, median(x) FILTER (WHERE first) - median(x) FILTER (WHERE NOT first) AS d FROM x GROUP BY 1, 2, 3)
    SELECT subject, n, CASE WHEN n // 2 >= 5 THEN round(sqrt(sum(d * d) * 2 / count(*)), 6) END AS drift FROM m GROUP BY 1, 2""")
def a15(spark: SparkSession, d: str) -> DataFrame:
    return W.split_half_drift(vectors(spark, d), ["subject"], "frame_idx", "v", width=2).withColumn("drift", F.round("drift", 6))


@BOOK.add("u05_union_of_frames", "SELECT o_custkey AS subject, o_orderkey AS frame_idx FROM orders UNION SELECT l_suppkey, l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
def u05(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("frame_idx"))
    b = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("subject"), F.col("l_orderkey").alias("frame_idx"))
    return a.unionByName(b).distinct()


@BOOK.add("u06_frames_shared", """WITH s AS (SELECT DISTINCT l_orderkey AS f, l_suppkey AS s FROM lineitem), p AS (SELECT s_suppkey AS a, s_suppkey + 1 AS b FROM supplier)
    SELECT a, b, EXISTS (SELECT 1 FROM s x JOIN s y ON x.f = y.f WHERE x.s = p.a AND y.s = p.b) AS overlap FROM p""")
def u06(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 1).alias("b"))
    return J.sharing_frames(pairs, table(spark, d, "lineitem"), [], "l_orderkey", "l_suppkey")
