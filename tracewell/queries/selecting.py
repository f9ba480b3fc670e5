"""Selection, join and set queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions.vectors import cosine, mean_vector
from tracewell.operators import joins as J
from tracewell.operators import selection as K
from tracewell.operators.aggregates import cohort_median
from tracewell.operators.windows import robust_z
from tracewell.queries.book import CENTRES, FRAMES, VECTORS, Book, frames, parts_of, rounded, table, vectors

BOOK = Book()
KEYS = ["track_id"]


def _greedy_sql(source: str, k: int, gap: int) -> str:
    """A recursive choice: from each pick on to the best later row that is far enough from all picks."""
    return f"""r AS (SELECT track_id, frame_idx, value, row_number() OVER (PARTITION BY track_id ORDER BY value DESC, frame_idx) AS n FROM {source}),
    g(track_id, pick, n, frame_idx, value, got) AS (SELECT track_id, 1, n, frame_idx, value, [frame_idx] FROM r WHERE n = 1 UNION ALL
        SELECT track_id, pick, n, frame_idx, value, got FROM (SELECT g.track_id, g.pick + 1 AS pick, r.n, r.frame_idx, r.value, list_append(g.got, r.frame_idx) AS got, row_number() OVER (PARTITION BY g.track_id ORDER BY r.n) AS first
        FROM g JOIN r ON r.track_id = g.track_id AND r.n > g.n AND g.pick < {k} AND len(list_filter(g.got, lambda y: abs(y - r.frame_idx) < {gap})) = 0) WHERE first = 1)"""


@BOOK.add("k02_greedy_separated", f"WITH RECURSIVE {FRAMES}, {_greedy_sql('f', 3, 12)} SELECT track_id, pick, frame_idx, value FROM g")
def k02(spark: SparkSession, d: str) -> DataFrame:
    return K.greedy_separated(frames(spark, d), KEYS, "frame_idx", "value", 3, 12)


@BOOK.add("k03_greedy_if_enough", f"WITH RECURSIVE {FRAMES}, a AS (SELECT * FROM f WHERE event_type = 'click'), {_greedy_sql('a', 5, 6)} SELECT track_id, pick, frame_idx, value FROM g WHERE track_id IN (SELECT track_id FROM a GROUP BY 1 HAVING count(*) >= 5)")
def k03(spark: SparkSession, d: str) -> DataFrame:
    admitted = frames(spark, d).where("event_type = 'click'")
    return K.if_enough(K.greedy_separated(admitted, KEYS, "frame_idx", "value", 5, 6), admitted, KEYS, 5)


@BOOK.add("k06_relaxed_top", f"""WITH RECURSIVE {FRAMES}, a AS (SELECT * FROM f WHERE k < 20), b AS (SELECT * FROM f WHERE k < 60), {_greedy_sql('a', 3, 8)}, {_greedy_sql('b', 3, 8).replace('r AS', 'r2 AS').replace('FROM r ', 'FROM r2 ').replace('JOIN r ON', 'JOIN r2 AS r ON').replace('g(track', 'g2(track').replace('FROM g JOIN', 'FROM g2 AS g JOIN')},
    whole AS (SELECT track_id FROM g GROUP BY 1 HAVING count(*) = 3)
    SELECT track_id, 'strict' AS note, pick, frame_idx, value FROM g WHERE track_id IN (SELECT track_id FROM whole) UNION ALL SELECT track_id, 'loose', pick, frame_idx, value FROM g2 WHERE track_id NOT IN (SELECT track_id FROM whole)""")
def k06(spark: SparkSession, d: str) -> DataFrame:
    return K.relaxed_top(frames(spark, d), KEYS, "frame_idx", "value", [("strict", F.col("k") < 20), ("loose", F.col("k") < 60)], [8])


@BOOK.add("k07_best_per_bin", f"WITH {FRAMES}, r AS (SELECT *, row_number() OVER (PARTITION BY track_id, event_type ORDER BY value DESC, frame_idx) AS n FROM f) SELECT track_id, event_type, frame_idx, value, true AS preferred FROM r WHERE n = 1")
def k07(spark: SparkSession, d: str) -> DataFrame:
    return K.best_per_bin(frames(spark, d), KEYS, "event_type", "value", "frame_idx")


@BOOK.add("k08_best_with_floor", f"WITH {FRAMES}, r AS (SELECT *, k >= 40 AS preferred, row_number() OVER (PARTITION BY track_id, event_type ORDER BY k >= 40 DESC, value DESC, frame_idx) AS n FROM f) SELECT track_id, event_type, frame_idx, value, preferred FROM r WHERE n = 1")
def k08(spark: SparkSession, d: str) -> DataFrame:
    return K.best_per_bin(frames(spark, d), KEYS, "event_type", "value", "frame_idx", F.col("k") >= 40)


@BOOK.add("k11_top_entries", """WITH v AS (SELECT l_orderkey, l_linenumber, unnest([{'name': 'discount', 'value': l_discount - 0.05}, {'name': 'quantity', 'value': 0.25 - l_quantity / 100}, {'name': 'tax', 'value': l_tax}]) AS e FROM (SELECT l_orderkey, l_linenumber, min(l_discount) AS l_discount, min(l_quantity) AS l_quantity, min(l_tax) AS l_tax FROM lineitem GROUP BY 1, 2)),
    r AS (SELECT l_orderkey, l_linenumber, e, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY abs(e.value) DESC, e.name) AS n FROM v) SELECT l_orderkey, l_linenumber, max(CASE WHEN n = 1 THEN e.name END) AS first, max(CASE WHEN n = 2 THEN e.name END) AS second FROM r GROUP BY 1, 2""")
def k11(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_discount", "l_quantity", "l_tax")])
    top = K.top_entries({"discount": F.col("l_discount") - 0.05, "quantity": 0.25 - F.col("l_quantity") / 100, "tax": F.col("l_tax")}, 2, by_size=True)
    return lines.withColumn("t", top).select("l_orderkey", "l_linenumber", F.col("t")[0]["name"].alias("first"), F.col("t")[1]["name"].alias("second"))


@BOOK.add("k12_every", f"WITH {FRAMES} SELECT track_id, frame_idx FROM f WHERE frame_idx % 5 = 0")
def k12(spark: SparkSession, d: str) -> DataFrame:
    return K.every(frames(spark, d), KEYS, "frame_idx", 5).select("track_id", "frame_idx")


@BOOK.add("k12_evenly_spaced", f"""WITH {FRAMES}, n AS (SELECT track_id, count(*) AS n FROM f GROUP BY 1), w AS (SELECT DISTINCT track_id, CASE WHEN n <= 7 THEN i ELSE CAST(floor(i * (n - 1) / 6) AS BIGINT) END AS frame_idx FROM n, range(0, 7) t(i) WHERE i < n)
    SELECT track_id, frame_idx FROM w""")
def k12_evenly(spark: SparkSession, d: str) -> DataFrame:
    return K.evenly_spaced(frames(spark, d), KEYS, "frame_idx", 7).select("track_id", "frame_idx")


@BOOK.add("k13_seeded", f"WITH {FRAMES}, r AS (SELECT track_id, event_id, CAST(row_number() OVER (PARTITION BY track_id ORDER BY md5('s1/' || event_id), event_id) AS INTEGER) AS draw FROM f) SELECT * FROM r WHERE draw <= 4")
def k13(spark: SparkSession, d: str) -> DataFrame:
    return K.seeded(frames(spark, d), KEYS, "event_id", "s1", 4).select("track_id", "event_id", "draw")


@BOOK.add("f03_cohort_support", f"WITH {FRAMES}, a AS (SELECT *, count(CASE WHEN event_type = 'click' THEN 1 END) OVER (PARTITION BY track_id) AS n FROM f) SELECT track_id, frame_idx FROM a WHERE event_type = 'click' OR n < 10")
def f03(spark: SparkSession, d: str) -> DataFrame:
    return K.with_support(frames(spark, d), KEYS, F.col("event_type") == "click", 10).select("track_id", "frame_idx")


@BOOK.add("flagship_moments", f"""WITH RECURSIVE {FRAMES}, a AS (SELECT *, median(value) OVER (PARTITION BY track_id) AS m FROM f), b AS (SELECT *, median(abs(value - m)) OVER (PARTITION BY track_id) AS d FROM a),
    z AS (SELECT track_id, frame_idx, round((value - m) / (d * 1.4826 + 1e-9), 6) AS value FROM b WHERE d > 0), {_greedy_sql('z', 3, 12)} SELECT track_id, pick, frame_idx, value AS z FROM g""")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """For each track the three most unusual frames, at least twelve frames apart."""
    w = Window.partitionBy(*KEYS)
    own = frames(spark, d).withColumn("m", F.median("value").over(w)).withColumn("d", F.median(F.abs(F.col("value") - F.col("m"))).over(w)).where("d > 0")
    z = rounded(robust_z(own.drop("m", "d"), "value", KEYS, "z"), "z")
    return K.greedy_separated(z, KEYS, "frame_idx", "z", 3, 12)


@BOOK.add("j01_frame_table", """SELECT l.l_orderkey, l.l_linenumber, l.l_quantity, o.o_orderpriority, c.c_mktsegment, n.n_name FROM lineitem l LEFT JOIN orders o ON o.o_orderkey = l.l_orderkey AND o.o_orderstatus <> 'P'
    LEFT JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey""")
def j01(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    orders = table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority")
    with_orders = J.frame_table(lines, [orders], ["l_orderkey"])
    buyers = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", F.col("c_nationkey").alias("n_nationkey"))
    places = table(spark, d, "nation").select("n_nationkey", "n_name")
    return J.frame_table(J.frame_table(with_orders, [buyers], ["o_custkey"]), [places], ["n_nationkey"]).select("l_orderkey", "l_linenumber", "l_quantity", "o_orderpriority", "c_mktsegment", "n_name")


@BOOK.add("j03_strict_alignment", """WITH l AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), p AS (SELECT p_partkey, p_size FROM part WHERE p_size <> 50), j AS (SELECT l_suppkey, l_partkey, p_size, max(CAST(p_partkey IS NULL AS INT)) OVER (PARTITION BY l_suppkey) AS lost FROM l LEFT JOIN p ON p_partkey = l_partkey)
    SELECT l_suppkey, l_partkey, CASE WHEN lost = 0 THEN p_size END AS p_size FROM j""")
def j03(spark: SparkSession, d: str) -> DataFrame:
    whole = table(spark, d, "lineitem")
    n = parts_of(whole)
    lines = whole.select("l_suppkey", "l_partkey").repartition(n, "l_suppkey", "l_partkey").distinct()
    sizes = table(spark, d, "part").where("p_size <> 50").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    pairs = lines.repartition(n, "l_partkey").join(sizes.repartition(n, "l_partkey"), "l_partkey").select("l_suppkey", "l_partkey", "p_size")
    return J.strictly_aligned(lines, pairs, ["l_suppkey"], "l_partkey", n).select("l_suppkey", "l_partkey", "p_size")


@BOOK.add("j05_semi_anti", """SELECT s_suppkey, EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R' AND l_quantity > 49) AS seen FROM supplier""")
def j05(spark: SparkSession, d: str) -> DataFrame:
    makers = table(spark, d, "supplier").select("s_suppkey")
    seen = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"))
    return makers.join(seen, "s_suppkey", "left_semi").withColumn("seen", F.lit(True)).unionByName(makers.join(seen, "s_suppkey", "left_anti").withColumn("seen", F.lit(False)))


@BOOK.add("j06_together", "SELECT l_orderkey, min(l_suppkey) AS a, max(l_suppkey) AS b FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 2")
def j06(spark: SparkSession, d: str) -> DataFrame:
    return J.together(table(spark, d, "lineitem"), ["l_orderkey"], "l_suppkey")


@BOOK.add("j07_adjacent_change", """WITH l AS (SELECT l_orderkey, l_linenumber, min(l_quantity) AS q, min(l_tax) AS t FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, l_linenumber,
    CASE WHEN l_linenumber - lag(l_linenumber) OVER w = 1 THEN round(abs(q - lag(q) OVER w) + abs(t - lag(t) OVER w), 6) END AS change FROM l WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)""")
def j07(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.array(F.min("l_quantity"), F.min("l_tax")).alias("v"))
    return lines.select("l_orderkey", "l_linenumber", F.round(J.change_if_adjacent(F.col("v"), ["l_orderkey"], "l_linenumber"), 6).alias("change"))


@BOOK.add("j08_similar_pairs", f"WITH {VECTORS}, {CENTRES} SELECT x.subject AS a, y.subject AS b, round(list_cosine_similarity(x.c, y.c), 6) AS cos FROM c x JOIN c y ON x.subject < y.subject WHERE list_cosine_similarity(x.c, y.c) >= -0.2")
def j08(spark: SparkSession, d: str) -> DataFrame:
    centres = mean_vector(vectors(spark, d), ["subject"], "v", "c").withColumn("clip", F.lit(1))
    return rounded(J.similar_pairs(centres, ["clip"], "subject", "c", -0.2).drop("clip"), "cos")


@BOOK.add("j09_rivals", f"""WITH {VECTORS}, {CENTRES}, a AS (SELECT frame_idx, max(CASE WHEN c.subject = e.subject THEN list_cosine_similarity(v, c) END) AS cos_self, max(CASE WHEN c.subject <> e.subject THEN list_cosine_similarity(v, c) END) AS cos_other FROM e JOIN c ON true GROUP BY 1)
    SELECT frame_idx, round(cos_self, 6) AS cos_self, round(cos_other, 6) AS cos_other FROM a""")
def j09(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d).withColumn("clip", F.lit(1))
    centres = mean_vector(rows, ["clip", "subject"], "v", "c")
    return rounded(J.rival_similarity(rows, centres, ["clip"], "subject", "v", "c").select("frame_idx", "cos_self", "cos_other"), "cos_self", "cos_other")


@BOOK.add("j13_nearest_in_time", f"""WITH {FRAMES}, a AS (SELECT track_id, event_id, ts FROM f WHERE event_type = 'click'), b AS (SELECT track_id, event_id AS other, ts AS t FROM f WHERE event_type = 'error'),
    p AS (SELECT a.track_id, a.event_id, other, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(epoch_us(a.ts) - epoch_us(t)), t) AS n FROM a LEFT JOIN b ON b.track_id = a.track_id) SELECT track_id, event_id, other AS nearest FROM p WHERE n = 1""")
def j13(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    left, right = f.where("event_type = 'click'").select("track_id", "event_id", "t"), f.where("event_type = 'error'").select("track_id", F.col("event_id").alias("other"), "t")
    return J.nearest_in_time(left, right, KEYS, "t", "other").select("track_id", "event_id", "nearest")


@BOOK.add("j14_within", f"WITH {FRAMES} SELECT a.track_id, a.frame_idx, b.frame_idx AS label_frame FROM f a JOIN f b ON a.track_id = b.track_id AND abs(a.frame_idx - b.frame_idx) <= 3 WHERE a.event_type = 'click' AND b.event_type = 'error'")
def j14(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d)
    right = f.where("event_type = 'error'").select("track_id", F.col("frame_idx").alias("label_frame"))
    return J.within(f.where("event_type = 'click'").select("track_id", "frame_idx"), right, KEYS, "frame_idx", "label_frame", 3)


@BOOK.add("j16_in_intervals", f"WITH {FRAMES}, i AS (SELECT track_id, frame_idx - 2 AS s, frame_idx + 5 AS e FROM f WHERE event_type = 'purchase') SELECT f.track_id, f.frame_idx, s, e FROM f JOIN i ON i.track_id = f.track_id AND f.frame_idx BETWEEN s AND e WHERE f.value > 80")
def j16(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d)
    spans = f.where("event_type = 'purchase'").select("track_id", (F.col("frame_idx") - 2).alias("s"), (F.col("frame_idx") + 5).alias("e"))
    return J.in_intervals(f.where("value > 80").select("track_id", "frame_idx"), spans, KEYS, "frame_idx", "s", "e", 8)


@BOOK.add("j15_overlap", """SELECT a.event_id AS a, b.event_id AS b, greatest(least(a.event_id + 30, b.event_id + 30) - greatest(a.event_id, b.event_id), 0) AS shared FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.event_id < b.event_id WHERE least(a.event_id, b.event_id) + 30 > greatest(a.event_id, b.event_id)""")
def j15(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).select("track_id", "event_type", "event_id")
    pairs = J.within(f.withColumnRenamed("event_id", "a"), f.withColumnRenamed("event_id", "b"), ["track_id", "event_type"], "a", "b", 29).where("a < b")
    shared = J.overlap(F.col("a"), F.col("a") + 30, F.col("b"), F.col("b") + 30)
    return pairs.select("a", "b", shared.alias("shared")).where("shared > 0")


@BOOK.add("j17_merged_frames", "SELECT user_id, date_trunc('day', ts) AS day, max(value) AS value, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS k, count(*) AS riders FROM events GROUP BY 1, 2")
def j17(spark: SparkSession, d: str) -> DataFrame:
    from tracewell.operators.aggregates import merged_frames

    f = frames(spark, d).withColumnsRenamed({"track_id": "user_id"}).withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return merged_frames(f, ["user_id", "day"], ["value", "k"])


@BOOK.add("u01_union_streams", "SELECT o_orderkey AS id, o_totalprice AS score, o_orderpriority AS note FROM orders UNION ALL SELECT event_id, value, NULL FROM events")
def u01(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"), F.col("o_orderpriority").alias("note"))
    return a.unionByName(table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("value").alias("score")), allowMissingColumns=True)


@BOOK.add("u02_u03_set_difference", "SELECT l_partkey AS part, 'both' AS side FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A') UNION ALL SELECT l_partkey, 'first' FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')")
def u02(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    r, a = (lines.where(F.col("l_returnflag") == x).select(F.col("l_partkey").alias("part")) for x in "RA")
    return r.intersect(a).withColumn("side", F.lit("both")).unionByName(r.exceptAll(a).distinct().join(a, "part", "left_anti").withColumn("side", F.lit("first")))


@BOOK.add("u04_drift", "WITH a AS (SELECT DISTINCT l_suppkey AS s FROM lineitem WHERE l_quantity > 48 AND l_tax < 0.02), b AS (SELECT s_suppkey AS s FROM supplier WHERE s_acctbal > 0) SELECT coalesce(a.s, b.s) AS s, CASE WHEN a.s IS NULL THEN 'absent' ELSE 'undeclared' END AS problem FROM a FULL JOIN b ON a.s = b.s WHERE a.s IS NULL OR b.s IS NULL")
def u04(spark: SparkSession, d: str) -> DataFrame:
    from tracewell.plans.catalog import drift

    present = table(spark, d, "lineitem").where("l_quantity > 48 and l_tax < 0.02").select(F.col("l_suppkey").alias("s"))
    return drift(table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("s")), present, "s")


@BOOK.add("a04_cohort_median", f"WITH {FRAMES} SELECT track_id, frame_idx, round(coalesce(median(CASE WHEN event_type = 'click' THEN value END) OVER (PARTITION BY track_id), median(value) OVER (PARTITION BY track_id)), 6) AS ref FROM f")
def a04(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).select("track_id", "frame_idx", F.round(cohort_median(F.col("value"), F.col("event_type") == "click", KEYS), 6).alias("ref"))


@BOOK.add("q15_scene_cosines", f"WITH {VECTORS}, n AS (SELECT *, lead(v) OVER (ORDER BY frame_idx) AS w FROM e) SELECT frame_idx, round(list_cosine_similarity(v, w), 6) AS cos FROM n WHERE w IS NOT NULL")
def q15(spark: SparkSession, d: str) -> DataFrame:
    own = vectors(spark, d)
    after = own.select((F.col("frame_idx") - 1).alias("frame_idx"), F.col("v").alias("w"))
    return own.join(after, "frame_idx").select("frame_idx", F.round(cosine(F.col("v"), F.col("w")), 6).alias("cos"))
