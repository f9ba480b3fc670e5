"""Aggregate, evaluation, catalog and streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions import numbers as N
from tracewell.functions import text as X
from tracewell.functions.vectors import mean_vector, normalised
from tracewell.operators import aggregates as A
from tracewell.operators import centres, kernels, moments
from tracewell.operators.windows import robust_z
from tracewell.plans import catalog, evals, readings, subjects
from tracewell.queries.book import CENTRES, FRAMES, VECTORS, Book, dealt, frames, rounded, table, vectors
from tracewell.sources.checkpoints import scratch
from tracewell.sources.tables import latest, manifest
from tracewell.streaming import streams
from tracewell.streaming.phrases import drained_phrases, phrases

BOOK = Book()
KEYS = ["track_id"]


@BOOK.add("a01_persistent", "WITH t AS (SELECT greatest(floor(count(DISTINCT CAST(ts AS DATE)) * 0.5), 1) AS least FROM events) SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS n FROM events GROUP BY 1 HAVING count(DISTINCT CAST(ts AS DATE)) >= (SELECT least FROM t)")
def a01(spark: SparkSession, d: str) -> DataFrame:
    return A.persistent(table(spark, d, "events").withColumn("day", F.to_date("ts")), "user_id", "day", 0.5)


@BOOK.add("a02_top_group", "SELECT event_type, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 20 ORDER BY n DESC, event_type LIMIT 1")
def a02(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).where("n >= 20").orderBy(F.desc("n"), "event_type").limit(1)


@BOOK.add("a03_track_health", "SELECT l_suppkey, count(DISTINCT l_orderkey) AS n, min(l_orderkey) AS first, max(l_orderkey) AS last, max(l_orderkey) - min(l_orderkey) + 1 - count(DISTINCT l_orderkey) AS gaps FROM lineitem GROUP BY 1")
def a03(spark: SparkSession, d: str) -> DataFrame:
    return A.track_health(table(spark, d, "lineitem"), ["l_suppkey"], "l_orderkey")


@BOOK.add("a04_supported_median", f"WITH {FRAMES} SELECT track_id, frame_idx, CASE WHEN count(value) OVER (PARTITION BY track_id) >= 60 THEN round(0.5 * median(value) OVER (PARTITION BY track_id), 6) ELSE -1 END AS floor FROM f")
def a04(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).select("track_id", "frame_idx", F.round(A.supported_median(F.col("value"), KEYS, 60, 0.5, -1.0), 6).alias("floor"))


@BOOK.add("a05_centroids", f"""WITH {VECTORS}, u AS (SELECT subject, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM e), {CENTRES.replace('FROM e)', 'FROM u)')}
    SELECT subject, round(list_inner_product(c, c), 6) AS square, round(c[1], 6) AS first, round(c[64], 6) AS last FROM c""")
def a05(spark: SparkSession, d: str) -> DataFrame:
    centres = mean_vector(vectors(spark, d).withColumn("u", normalised(F.col("v"))), ["subject"], "u", "c")
    return rounded(centres.select("subject", F.aggregate("c", F.lit(0.0), lambda s, x: s + x * x).alias("square"), F.col("c")[0].alias("first"), F.col("c")[63].alias("last")), "square", "first", "last")


@BOOK.add("a06_median_centroids", f"WITH {VECTORS}, x AS (SELECT subject, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e) SELECT subject, round(median(CASE WHEN pos = 1 THEN x END), 6) AS first, round(median(CASE WHEN pos = 64 THEN x END), 6) AS last FROM x GROUP BY 1")
def a06(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mean_vector(vectors(spark, d), ["subject"], "v", "c", robust=True).select("subject", F.col("c")[0].alias("first"), F.col("c")[63].alias("last")), "first", "last")


@BOOK.add("a07_coherence", f"""WITH {VECTORS}, u AS (SELECT subject, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM e), {CENTRES.replace('FROM e)', 'FROM u)')}, s AS (SELECT u.subject, list_cosine_similarity(v, c) AS cos FROM u JOIN c ON c.subject = u.subject)
    SELECT subject, count(*) AS n, round(avg(cos), 6) AS coherence, round(quantile_cont(cos, 0.05), 6) AS coherence_p05, avg(cos) < 0.5 AS low_confidence FROM s GROUP BY 1""")
def a07(spark: SparkSession, d: str) -> DataFrame:
    return rounded(readings.identity(vectors(spark, d), ["subject"], "v", F.lit(True)), "coherence", "coherence_p05")


@BOOK.add("a08_worn", """WITH g AS (SELECT l_suppkey, avg(CAST(coalesce(CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity > 25 END, false) AS INT)) AS a, avg(CAST(l_tax >= 0.01 AS INT)) AS b FROM lineitem GROUP BY 1)
    SELECT l_suppkey, round(a, 6) AS hat_share, round(b, 6) AS glasses_share, CASE WHEN a > 0.3 AND a < 0.7 THEN 'variable' WHEN a >= 0.5 THEN 'worn' ELSE 'absent' END AS hat, CASE WHEN b > 0.3 AND b < 0.7 THEN 'variable' WHEN b >= 0.5 THEN 'worn' ELSE 'absent' END AS glasses FROM g""")
def a08(spark: SparkSession, d: str) -> DataFrame:
    hat = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity") > 25)
    return rounded(readings.worn(table(spark, d, "lineitem"), ["l_suppkey"], {"hat": hat, "glasses": F.col("l_tax") >= 0.01}), "hat_share", "glasses_share")


@BOOK.add("a10_quantile_baseline", f"""WITH {FRAMES}, v AS (SELECT track_id, value - 40 AS x FROM f), q AS (SELECT *, quantile_cont(x, 0.75) OVER (PARTITION BY track_id) AS p FROM v)
    SELECT track_id, count(x) AS n, round(quantile_cont(x, 0.1), 6) AS p10, round(quantile_cont(x, 0.25), 6) AS p25, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.75), 6) AS p75, round(quantile_cont(x, 0.9), 6) AS p90,
    round(quantile_cont(x, 0.9) - quantile_cont(x, 0.1), 6) AS spread, count(*) FILTER (x > 0) AS positive, count(*) FILTER (x < 0) AS negative, count(*) FILTER (x >= p) AS strong FROM q GROUP BY 1""")
def a10(spark: SparkSession, d: str) -> DataFrame:
    own = frames(spark, d).select("track_id", (F.col("value") - 40).alias("x"))
    return rounded(A.quantile_baseline(own, KEYS, "x"), "p10", "p25", "p50", "p75", "p90", "spread")


@BOOK.add("a11_top_modes", f"WITH {FRAMES}, c AS (SELECT track_id, event_type, count(*) AS n, min(frame_idx) AS first FROM f GROUP BY 1, 2), r AS (SELECT track_id, event_type, n, CAST(row_number() OVER (PARTITION BY track_id ORDER BY n DESC, first, event_type) AS INTEGER) AS rank FROM c) SELECT * FROM r WHERE rank <= 2")
def a11(spark: SparkSession, d: str) -> DataFrame:
    return A.top_modes(frames(spark, d), KEYS, "event_type", "frame_idx")


@BOOK.add("a12_vote", """SELECT l_suppkey, count(*) FILTER (l_quantity > 25) AS a_votes, count(*) FILTER (NOT l_quantity > 25) AS b_votes, CASE WHEN count(*) FILTER (l_quantity > 25) >= count(*) FILTER (NOT l_quantity > 25) THEN 'a' ELSE 'b' END AS winner,
    round(abs(count(*) FILTER (l_quantity > 25) - count(*) FILTER (NOT l_quantity > 25)) / count(*), 6) AS margin FROM lineitem GROUP BY 1""")
def a12(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.vote(table(spark, d, "lineitem"), ["l_suppkey"], F.col("l_quantity") > 25), "margin")


@BOOK.add("a13_best_and_second", f"WITH {FRAMES}, m AS (SELECT track_id, event_type, max(value) AS s FROM f GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY s DESC, event_type) AS n FROM m) SELECT track_id, max(CASE WHEN n = 1 THEN event_type END) AS best, max(CASE WHEN n = 1 THEN s END) AS best_score, max(CASE WHEN n = 2 THEN s END) AS second_score, round(max(CASE WHEN n = 1 THEN s END) - max(CASE WHEN n = 2 THEN s END), 6) AS margin FROM r GROUP BY 1")
def a13(spark: SparkSession, d: str) -> DataFrame:
    best = frames(spark, d).groupBy("track_id", "event_type").agg(F.max("value").alias("s"))
    return rounded(A.best_and_second(best, KEYS, "event_type", "s"), "margin")


@BOOK.add("a19_weighted_stats", "SELECT l_suppkey, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 4) AS mean, round((sum(l_quantity * l_extendedprice * l_extendedprice) / sum(l_quantity) - pow(sum(l_quantity * l_extendedprice) / sum(l_quantity), 2)) / 1e6, 3) AS variance FROM lineitem GROUP BY 1")
def a19(spark: SparkSession, d: str) -> DataFrame:
    stats = A.weighted_stats(F.col("l_extendedprice"), F.col("l_quantity"))
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(stats["mean"], 4).alias("mean"), F.round(stats["variance"] / 1e6, 3).alias("variance"))


@BOOK.add("a19_entropy", f"WITH {FRAMES}, b AS (SELECT track_id, floor(value / 128 * 256) AS b, count(*) AS n FROM f WHERE value >= 0 AND value < 128 GROUP BY 1, 2), p AS (SELECT track_id, n / sum(n) OVER (PARTITION BY track_id) AS p FROM b) SELECT track_id, round(-sum(p * log2(p)), 6) AS bits FROM p GROUP BY 1")
def a19_entropy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.entropy(frames(spark, d), KEYS, "value", 256, 0.0, 128.0), "bits")


@BOOK.add("a20_top_dimensions", f"""WITH {VECTORS}, x AS (SELECT subject, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos FROM e), m AS (SELECT subject, pos, median(x) AS med, quantile_cont(x, 0.9) AS p90 FROM x WHERE pos < 10 GROUP BY 1, 2),
    r AS (SELECT subject, CAST(row_number() OVER (PARTITION BY subject ORDER BY med DESC, pos) AS INTEGER) AS rank, 'd' || pos AS name, round(med, 6) AS median, round(p90, 6) AS p90 FROM m) SELECT * FROM r WHERE rank <= 5""")
def a20(spark: SparkSession, d: str) -> DataFrame:
    return rounded(readings.top_dimensions(vectors(spark, d), ["subject"], "v", [f"d{i}" for i in range(10)]), "median", "p90")


@BOOK.add("a22_label_means", "WITH m AS (SELECT l_suppkey, avg(l_discount) AS a, avg(l_tax) AS b, avg(l_quantity / 1000) AS c FROM lineitem GROUP BY 1) SELECT l_suppkey, round(a, 6) AS p_discount, round(b, 6) AS p_tax, round(c, 6) AS p_quantity, round(greatest(a, b, c), 6) AS confidence, CASE greatest(a, b, c) WHEN a THEN 'discount' WHEN b THEN 'tax' ELSE 'quantity' END AS winner FROM m")
def a22(spark: SparkSession, d: str) -> DataFrame:
    out = A.label_means(table(spark, d, "lineitem"), ["l_suppkey"], {"discount": F.col("l_discount"), "tax": F.col("l_tax"), "quantity": F.col("l_quantity") / 1000})
    return rounded(out, "p_discount", "p_tax", "p_quantity", "confidence")


@BOOK.add("a26_latency", """WITH m AS (SELECT l_orderkey % 50 AS g, l_orderkey, l_linenumber, CASE WHEN l_quantity > 10 THEN l_quantity ELSE 0 END AS decode, CASE WHEN l_quantity <= 40 THEN l_extendedprice / 1000 ELSE 0 END AS detect FROM lineitem), u AS (SELECT g, 'decode' AS module, decode AS ms FROM m UNION ALL SELECT g, 'detect', detect FROM m)
    SELECT g, module, round(quantile_cont(ms, 0.5), 9) AS p50, round(quantile_cont(ms, 0.95), 9) AS p95, round(max(ms), 9) AS most FROM u GROUP BY 1, 2""")
def a26(spark: SparkSession, d: str) -> DataFrame:
    entry = lambda k, v, test: F.when(test, F.create_map(F.lit(k), v)).otherwise(F.create_map().cast("map<string,double>"))
    modules = F.map_concat(entry("decode", F.col("l_quantity"), F.col("l_quantity") > 10), entry("detect", F.col("l_extendedprice") / 1000, F.col("l_quantity") <= 40))
    return rounded(A.latency_profile(table(spark, d, "lineitem").select((F.col("l_orderkey") % 50).alias("g"), modules.alias("modules")), ["g"], "modules"), "p50", "p95", "most", places=9)


@BOOK.add("a28_robust_spread", f"WITH {FRAMES} SELECT track_id, CASE WHEN count(value) >= 60 THEN round((quantile_cont(value, 0.9) - quantile_cont(value, 0.1)) / abs(quantile_cont(value, 0.5)), 6) END AS spread FROM f GROUP BY 1")
def a28(spark: SparkSession, d: str) -> DataFrame:
    return rounded(frames(spark, d).groupBy("track_id").agg(A.robust_spread("value", 60).alias("spread")), "spread")


@BOOK.add("a29_rank_correlation", """WITH r AS (SELECT l_suppkey, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2 AS a, rank() OVER (PARTITION BY l_suppkey ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_suppkey, l_discount) - 1) / 2 AS b FROM lineitem) SELECT l_suppkey, round(corr(a, b), 6) AS rho FROM r GROUP BY 1""")
def a29(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.rank_correlation(dealt(table(spark, d, "lineitem"), "l_suppkey"), ["l_suppkey"], "l_quantity", "l_discount"), "rho")


@BOOK.add("a31_outcomes", f"WITH {FRAMES} SELECT track_id, event_type, count(*) AS n, string_agg(event_id, ',' ORDER BY frame_idx) AS stages FROM f GROUP BY 1, 2")
def a31(spark: SparkSession, d: str) -> DataFrame:
    out = catalog.outcomes(frames(spark, d).withColumn("name", F.col("event_id").cast("string")), KEYS, "name", "event_type", "frame_idx")
    return out.withColumn("stages", F.concat_ws(",", "stages"))


@BOOK.add("a32_merged_distribution", "SELECT user_id, count(value) AS n, round(avg(value), 9) AS mean, round(var_pop(value) * count(value), 4) AS m2 FROM events GROUP BY 1")
def a32(spark: SparkSession, d: str) -> DataFrame:
    parts = A.distribution(table(spark, d, "events"), ["user_id", "event_type"], "value")
    return A.merged_distributions(parts, ["user_id"]).withColumns({"mean": F.round("mean", 9), "m2": F.round("m2", 4)})


@BOOK.add("a33_reason_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def a33(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@BOOK.add("f06_view_class", """WITH y AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 <> 0 THEN l_quantity * 3 - 75 END AS m, CASE WHEN l_linenumber % 5 <> 0 THEN CAST(l_partkey % 150 AS DOUBLE) - 75 END AS w FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN abs(w) >= 50 AND (m IS NULL OR (abs(m) >= 30 AND sign(m) = sign(w))) THEN 'side' WHEN abs(m) < 15 THEN 'frontal' WHEN m IS NOT NULL OR w IS NOT NULL THEN 'angle' END AS view FROM y""")
def f06(spark: SparkSession, d: str) -> DataFrame:
    m = F.when(F.col("l_linenumber") % 4 != 0, F.col("l_quantity") * 3 - 75)
    w = F.when(F.col("l_linenumber") % 5 != 0, (F.col("l_partkey") % 150).cast("double") - 75)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", N.view_class(m, w).alias("view"))


@BOOK.add("f05_f22_f30_scalars", """SELECT l_orderkey, l_linenumber, round(sqrt(pow(l_discount - 0, 2) + pow(l_tax - 0.35, 2) + 0.5 * pow(l_quantity / 50 - 0.1, 2)), 6) AS dist, round(least(1, greatest(0, (l_quantity - 5) / 35)), 6) AS u, round(exp(-pow(l_quantity - 12, 2) / 1800), 6) AS pref,
    round(CASE WHEN abs(l_quantity / 50 - l_discount * 10) > 0.55 THEN CASE WHEN abs(l_quantity / 50 - 0.5) <= abs(l_discount * 10 - 0.5) THEN l_quantity / 50 ELSE l_discount * 10 END ELSE (l_quantity / 50 + l_discount * 10) / 2 END, 6) AS pair,
    l_quantity >= 45 OR l_quantity <= 5 AS wraps FROM lineitem""")
def f05(spark: SparkSession, d: str) -> DataFrame:
    q, disc = F.col("l_quantity"), F.col("l_discount")
    parts = {"blink": disc, "smile": F.col("l_tax"), "jaw": q / 50}
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(N.point_distance(parts, {"blink": 0.0, "smile": 0.35, "jaw": 0.1}, {"blink": 1.0, "smile": 1.0, "jaw": 0.5}), 6).alias("dist"), F.round(N.unit(q, 5.0, 40.0), 6).alias("u"),
        F.round(N.preference(q, 12.0, 30.0, 0.05), 6).alias("pref"), F.round(N.balanced_pair(q / 50, disc * 10), 6).alias("pair"), N.in_arc(q, 45.0, 5.0).alias("wraps"),
    )


@BOOK.add("f13_f14_emotion", """SELECT l_orderkey, l_linenumber, round(l_quantity / 50 - (l_discount + l_tax), 6) AS valence, CASE WHEN l_quantity / 50 >= greatest(l_discount, l_tax) THEN 'happy' WHEN l_discount >= l_tax THEN 'sad' ELSE 'angry' END AS dominant FROM lineitem""")
def f13(spark: SparkSession, d: str) -> DataFrame:
    happy, sad, angry = F.col("l_quantity") / 50, F.col("l_discount"), F.col("l_tax")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(N.valence(happy, [sad, angry]), 6).alias("valence"), N.first_greatest(F.array(happy, sad, angry), ["happy", "sad", "angry"]).alias("dominant"))


@BOOK.add("f19_f20_boxes", """WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity * 10 AS x1, l_discount * 1000 AS y1, l_quantity * 10 + 80 + l_linenumber AS x2, l_discount * 1000 + 100 AS y2 FROM lineitem)
    SELECT l_orderkey, l_linenumber, round(sqrt(pow((x1 + x2) / 2 / 640 - 0.5, 2) + pow((y1 + y2) / 2 / 360 - 0.5, 2)), 6) AS centre_distance, round((x2 - x1) * (y2 - y1) / (640 * 360), 6) AS area_ratio, round((x2 - x1) / (y2 - y1), 6) AS aspect,
    CAST(round_even(greatest(0, least(640, (x1 + x2) / 2 - greatest(x2 - x1, y2 - y1) * 1.6 / 2)), 0) AS INT) AS left_edge FROM b""")
def f19(spark: SparkSession, d: str) -> DataFrame:
    x1, y1 = F.col("l_quantity") * 10, F.col("l_discount") * 1000
    x2, y2 = x1 + 80 + F.col("l_linenumber"), y1 + 100
    wide, tall = F.lit(640.0), F.lit(360.0)
    made = N.box_features(x1, y1, x2, y2, wide, tall)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[F.round(v, 6).alias(k) for k, v in made.items()], N.portrait_box(x1, y1, x2, y2, wide, tall)["x1"].alias("left_edge"))


@BOOK.add("f26_descriptions", "SELECT p_partkey, concat(concat_ws(', ', CASE WHEN p_size >= 40 THEN 'large' WHEN p_size >= 20 THEN 'middling' ELSE 'small' END, CASE WHEN p_retailprice > 1000 THEN 'dear' END), '.') AS text FROM part")
def f26(spark: SparkSession, d: str) -> DataFrame:
    words = [X.bucket(F.col("p_size"), [(40, "large"), (20, "middling")], "small"), F.when(F.col("p_retailprice") > 1000, "dear")]
    return table(spark, d, "part").select("p_partkey", X.described(words).alias("text"))


@BOOK.add("f27_line_scores", """WITH t AS (SELECT o_orderkey, '1: ' || (o_orderkey % 13) || chr(10) || 'none' || chr(10) || ' 2) ' || (o_custkey % 7) || '.5' AS t FROM orders) SELECT o_orderkey, 1 AS index, least(10.0, CAST(o_orderkey % 13 AS DOUBLE)) AS score FROM t UNION ALL SELECT o.o_orderkey, 2, CAST((o_custkey % 7) || '.5' AS DOUBLE) FROM orders o""")
def f27(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("1: "), F.col("o_orderkey") % 13, F.lit("\nnone\n 2) "), F.col("o_custkey") % 7, F.lit(".5"))
    return table(spark, d, "orders").select("o_orderkey", F.explode(X.line_scores(text)).alias("s")).select("o_orderkey", "s.*")


@BOOK.add("f28_keys", "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 's3://b/' || s_name WHEN 1 THEN 'file:///' || s_name WHEN 2 THEN 's3://home/' || s_name ELSE 'file://' || s_name END AS uri, 'a_t1' AS clip_id, s_suppkey AS track_id FROM supplier")
def f28(spark: SparkSession, d: str) -> DataFrame:
    raw = F.element_at(F.array(F.lit("s3://b/"), F.lit("/"), F.lit(""), F.lit("file://")), (F.col("s_suppkey") % 4 + 1).cast("int"))
    own = X.clip_and_track(F.concat(F.lit("a_t1_t"), F.col("s_suppkey")))
    return table(spark, d, "supplier").select("s_suppkey", X.source_uri(F.concat(raw, F.col("s_name")), "home").alias("uri"), own["clip_id"].alias("clip_id"), own["track_id"].alias("track_id"))


@BOOK.add("f33_screens", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_linenumber % 6 = 0 OR l_quantity >= 20) AND l_tax <= 0.06 AND l_discount BETWEEN 0.02 AND 0.08")
def f33(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").withColumn("q", F.when(F.col("l_linenumber") % 6 != 0, F.col("l_quantity")))
    return lines.where(N.passes({"q": (20, None), "l_tax": (None, 0.06), "l_discount": (0.02, 0.08)})).select("l_orderkey", "l_linenumber")


@BOOK.add("f37_softmax", "WITH e AS (SELECT l_orderkey, l_linenumber, exp(l_quantity / 10 - m) AS a, exp(l_discount * 50 - m) AS b FROM (SELECT *, greatest(l_quantity / 10, l_discount * 50) AS m FROM lineitem)) SELECT l_orderkey, l_linenumber, round(a / (a + b), 6) AS p FROM e")
def f37(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(N.softmax(F.array(F.col("l_quantity") / 10, F.col("l_discount") * 50))[0], 6).alias("p"))


_SHAPE_KEYS = [("Wide", "quantity", False), ("Wide", "discount", True), ("Deep", "tax", False)]


@BOOK.add("f24_shape_keys", """WITH a AS (SELECT l_suppkey, least(1, greatest(0, (avg(l_quantity) - 20) / 12)) AS q, 1 - least(1, greatest(0, (avg(l_discount) - 0.03) / 0.04)) AS d, least(1, greatest(0, (avg(l_tax) - 0.03) / 0.02)) AS t FROM lineitem GROUP BY 1),
    p AS (SELECT l_suppkey, 'Wide' AS shape_key, CASE WHEN abs(d - q) > 0.55 THEN CASE WHEN abs(d - 0.5) <= abs(q - 0.5) THEN d ELSE q END ELSE (d + q) / 2 END AS v FROM a UNION ALL SELECT l_suppkey, 'Deep', t FROM a)
    SELECT l_suppkey, shape_key, round(least(1, greatest(0, 0.5 + 2.2 * (v - 0.5))), 5) AS value FROM p""")
def f24(spark: SparkSession, d: str) -> DataFrame:
    means = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"))
    ranges = {"quantity": (20.0, 32.0), "discount": (0.03, 0.07), "tax": (0.03, 0.05)}
    axes = means.select("l_suppkey", F.explode(F.array(*[F.struct(F.lit(a).alias("axis_id"), F.col(a).alias("value_num"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for a, (lo, hi) in ranges.items()])).alias("e")).select("l_suppkey", "e.*")
    mapping = spark.createDataFrame(_SHAPE_KEYS, "shape_key string, axis_id string, flip boolean")
    return rounded(readings.shape_keys(axes, mapping, "l_suppkey", 2.2), "value", places=5)


@BOOK.add("f25_matched", """WITH l AS (SELECT DISTINCT p_brand, p_type FROM part WHERE p_partkey < 13), s AS (SELECT p.p_partkey, l.p_brand || '/' || l.p_type AS name, CAST(p.p_brand = l.p_brand AS INT) * 2.0 + CAST(p.p_type = l.p_type AS INT) * 1.0 AS score FROM part p JOIN l ON p.p_brand = l.p_brand OR p.p_type = l.p_type),
    r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, name) AS n FROM s) SELECT p_partkey, name, CAST(score AS DOUBLE) AS score FROM r WHERE n = 1""")
def f25(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part")
    library = parts.where("p_partkey < 13").select("p_brand", "p_type").distinct().withColumn("name", F.concat_ws("/", "p_brand", "p_type"))
    return readings.matched(parts, library, "name", "p_partkey", {"p_brand": 2.0, "p_type": 1.0})


@BOOK.add("e01_against_labels", f"""WITH {FRAMES}, c AS (SELECT track_id, frame_idx, row_number() OVER (PARTITION BY track_id ORDER BY value DESC, frame_idx) AS rank FROM f WHERE event_type <> 'error'), g AS (SELECT track_id, frame_idx AS lf FROM f WHERE event_type = 'error' AND k < 30),
    h AS (SELECT g.track_id, g.lf, c.rank FROM g LEFT JOIN c ON c.track_id = g.track_id AND c.rank <= 3 AND abs(c.frame_idx - g.lf) <= 4), t AS (SELECT track_id, min(rank) AS first, count(DISTINCT CASE WHEN rank IS NOT NULL THEN lf END) AS found, count(DISTINCT lf) AS wanted FROM h GROUP BY 1)
    SELECT round(avg(CASE WHEN first = 1 THEN 1 ELSE 0 END), 6) AS precision_at_1, round(avg(CASE WHEN first IS NOT NULL THEN 1 ELSE 0 END), 6) AS hit_at_k, round(sum(found) / sum(wanted), 6) AS recall_at_k FROM t WHERE track_id IN (SELECT track_id FROM c)""")
def e01(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d)
    rank = F.row_number().over(Window.partitionBy("track_id").orderBy(F.desc("value"), "frame_idx"))
    candidates = f.where("event_type <> 'error'").withColumn("rank", rank).select("track_id", "frame_idx", "rank")
    labels = f.where("event_type = 'error'").select("track_id", F.col("frame_idx").alias("label_frame"), (F.col("k") < 30).alias("good"))
    return rounded(evals.against_labels(candidates, labels, KEYS, 4, 3), "precision_at_1", "hit_at_k", "recall_at_k")


@BOOK.add("e02_pairs", f"""WITH {FRAMES}, r AS (SELECT track_id, event_id AS x, lead(event_id) OVER (PARTITION BY track_id ORDER BY value DESC, frame_idx) AS y FROM f), s AS (SELECT *, substr(md5(x || '/' || y), 1, 1) < '8' AS swap FROM r WHERE y IS NOT NULL) SELECT track_id, CASE WHEN swap THEN y ELSE x END AS a, CASE WHEN swap THEN x ELSE y END AS b FROM s""")
def e02(spark: SparkSession, d: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("track_id").orderBy(F.desc("value"), "frame_idx"))
    return evals.neighbour_pairs(frames(spark, d).withColumn("rank", rank), KEYS, "event_id")


_VERDICTS = "v AS (SELECT l_orderkey % 20 AS lane, l_suppkey AS track_id, l_partkey % 40 AS a_frame, l_partkey % 37 AS b_frame, CASE WHEN l_quantity > 25 THEN 'a' ELSE 'b' END AS system_pref, CASE l_returnflag WHEN 'R' THEN 'tie' WHEN 'A' THEN 'a' ELSE 'b' END AS winner FROM lineitem)"


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    winner = F.when(F.col("l_returnflag") == "R", "tie").when(F.col("l_returnflag") == "A", "a").otherwise("b")
    return table(spark, d, "lineitem").select((F.col("l_orderkey") % 20).alias("lane"), F.col("l_suppkey").alias("track_id"), (F.col("l_partkey") % 40).alias("a_frame"), (F.col("l_partkey") % 37).alias("b_frame"), F.when(F.col("l_quantity") > 25, "a").otherwise("b").alias("system_pref"), winner.alias("winner"))


@BOOK.add("e04_agreement", f"WITH {_VERDICTS} SELECT lane, count(*) AS n, count(*) FILTER (winner = 'tie') AS ties, round(avg(CASE WHEN winner <> 'tie' THEN CAST(winner = system_pref AS INT) END), 6) AS agreement FROM v GROUP BY 1")
def e04(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evals.agreement(_verdicts(spark, d), "lane"), "agreement")


@BOOK.add("e05_rescored", f"""WITH {_VERDICTS}, {FRAMES}, w AS (SELECT v.*, x.value AS sa, y.value AS sb FROM v JOIN f x ON x.track_id = v.track_id AND x.frame_idx = a_frame JOIN f y ON y.track_id = v.track_id AND y.frame_idx = b_frame)
    SELECT lane, count(*) AS n, count(*) FILTER (winner = 'tie') AS ties, round(avg(CASE WHEN winner <> 'tie' THEN CAST(winner = CASE WHEN sa > sb THEN 'a' ELSE 'b' END AS INT) END), 6) AS agreement FROM w GROUP BY 1""")
def e05(spark: SparkSession, d: str) -> DataFrame:
    scored = evals.rescored(_verdicts(spark, d), frames(spark, d), KEYS, "frame_idx", "value")
    return rounded(evals.agreement(scored, "lane"), "agreement")


@BOOK.add("e06_differences", "SELECT o_orderkey, 'o_totalprice' AS field, CAST(o_totalprice AS VARCHAR) AS old, CAST(o_totalprice + 1 AS VARCHAR) AS new FROM orders WHERE o_orderkey % 9 = 0 AND o_orderkey % 7 <> 0 UNION ALL SELECT o_orderkey, unnest(['o_totalprice', 'o_orderpriority']), unnest([CAST(o_totalprice AS VARCHAR), o_orderpriority]), NULL FROM orders WHERE o_orderkey % 7 = 0")
def e06(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    new = old.where("o_orderkey % 7 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 9 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice") + 1e-9))
    return evals.differences(old, new, ["o_orderkey"])


@BOOK.add("s11_latest", "WITH r AS (SELECT user_id, event_type, value, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n, CASE WHEN value > 5 THEN 'pos' END AS flag FROM events) SELECT user_id, event_type, value, event_id FROM r WHERE n = 1 AND flag IS NOT NULL")
def s11(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("flag", F.when(F.col("value") > 5, "pos"))
    return latest(rows, ["user_id", "event_type"], "ts", "event_id", "flag").select("user_id", "event_type", "value", "event_id")


@BOOK.add("s15_manifest", "WITH l AS (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem), m AS (SELECT l_suppkey, l_orderkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) - 1 AS ordinal, count(*) OVER (PARTITION BY l_suppkey) AS n FROM l) SELECT l_suppkey, l_orderkey, CAST(ordinal AS INTEGER) AS ordinal FROM m WHERE n >= 20")
def s15(spark: SparkSession, d: str) -> DataFrame:
    return manifest(table(spark, d, "lineitem").select("l_suppkey", "l_orderkey").distinct(), ["l_suppkey"], "l_orderkey", 20)


@BOOK.add("q09_main_rider", """WITH p AS (SELECT l_orderkey, min(l_suppkey) AS a, max(l_suppkey) AS b FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 2), n AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY l_orderkey) - 1 AS n FROM p), q AS (SELECT l_orderkey, l_suppkey, min(l_extendedprice) AS d FROM lineitem GROUP BY 1, 2),
    v AS (SELECT n.a, n.b, x.d <= y.d AS first FROM n JOIN q x ON x.l_orderkey = n.l_orderkey AND x.l_suppkey = n.a JOIN q y ON y.l_orderkey = n.l_orderkey AND y.l_suppkey = n.b WHERE n.n % 5 = 0)
    SELECT a, b, count(*) FILTER (first) AS a_votes, count(*) FILTER (NOT first) AS b_votes, CASE WHEN count(*) FILTER (first) >= count(*) FILTER (NOT first) THEN 'a' ELSE 'b' END AS winner FROM v GROUP BY 1, 2""")
def q09(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.min("l_extendedprice").alias("depth")).withColumn("clip", F.lit(1))
    return subjects.main_rider(rows, "clip", "l_orderkey", "l_suppkey", "depth").drop("clip", "margin")


@BOOK.add("q12_emotion_baseline", f"""WITH {FRAMES}, v AS (SELECT track_id, frame_idx, event_type AS label, value - 40 AS x, count(*) FILTER (event_type <> 'signup') OVER (PARTITION BY track_id) AS rides FROM f WHERE value IS NOT NULL),
    o AS (SELECT *, quantile_cont(x, [0.1, 0.75, 0.9]) OVER (PARTITION BY track_id) AS q FROM v WHERE rides < 30 OR label <> 'signup'),
    b AS (SELECT track_id, count(*) AS n, quantile_cont(x, [0.1, 0.25, 0.5, 0.75, 0.9]) AS p, count(*) FILTER (x > 0) AS positive, count(*) FILTER (x < 0) AS negative, count(*) FILTER (x >= q[2]) AS strong FROM o GROUP BY 1),
    t AS (SELECT track_id, label, high, count(*) AS n, min(frame_idx) AS seen FROM (SELECT *, true AS high FROM o WHERE x >= q[3] UNION ALL SELECT *, false FROM o WHERE x <= q[1]) GROUP BY 1, 2, 3),
    m AS (SELECT *, row_number() OVER (PARTITION BY track_id, high ORDER BY n DESC, seen, label) AS i FROM t)
    SELECT track_id, n, round(p[1], 6) AS p10, round(p[2], 6) AS p25, round(p[3], 6) AS p50, round(p[4], 6) AS p75, round(p[5], 6) AS p90, round(p[5] - p[1], 6) AS spread, positive, negative, strong,
        (SELECT max(label) FROM m WHERE m.track_id = b.track_id AND high AND i = 1) AS high_label, (SELECT max(label) FROM m WHERE m.track_id = b.track_id AND NOT high AND i = 1) AS low_label FROM b""")
def q12(spark: SparkSession, d: str) -> DataFrame:
    rows = frames(spark, d).withColumn("valence", F.col("value") - 40)
    base = readings.emotion_baseline(rows, KEYS, "frame_idx", F.col("event_type") != "signup", "event_type")
    return rounded(base, "p10", "p25", "p50", "p75", "p90", "spread")


@BOOK.add("q11_stitched")
def q11(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select((F.col("label") % 2).alias("clip"), F.col("vec_id").alias("frame"), (F.col("label") * 100 + F.col("vec_id") % 7).alias("track"), "embedding")
    return subjects.stitched(rows, "clip", "frame", "track", "embedding", 0.2)


@BOOK.add("d05_stale", "WITH a AS (SELECT o_orderkey, o_orderdate AS made, TIMESTAMP '1996-01-01' AS code FROM orders), u AS (SELECT l_orderkey, max(l_shipdate) AS up FROM lineitem GROUP BY 1) SELECT CAST(o_orderkey AS VARCHAR) AS artifact, coalesce(made < code OR made < up, made < code) AS stale FROM a LEFT JOIN u ON l_orderkey = o_orderkey")
def d05(spark: SparkSession, d: str) -> DataFrame:
    made = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("artifact"), F.col("o_orderdate").alias("made_at"), F.lit("1996-01-01").cast("timestamp_ntz").alias("code_at"))
    lines = table(spark, d, "lineitem").withColumn("line", F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    above = lines.select(F.col("line").alias("artifact"), F.col("l_shipdate").alias("made_at"), F.lit(None).cast("timestamp_ntz").alias("code_at"))
    links = lines.select(F.col("line").alias("upstream"), F.col("l_orderkey").cast("string").alias("artifact"))
    return catalog.stale(made.unionByName(above), links).where("artifact not like '%/%'")


@BOOK.add("d07_tiers", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'product' WHEN 1 THEN 'substrate' ELSE 'unclassified' END AS tier FROM orders")
def d07(spark: SparkSession, d: str) -> DataFrame:
    name = F.element_at(F.array(F.lit("likeness.json"), F.lit("tubelets.parquet"), F.lit("mystery.bin")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return catalog.tiered(table(spark, d, "orders").withColumn("name", name), "name").select("o_orderkey", "tier")


@BOOK.add("d12_intact", "SELECT l_suppkey, bool_and(coalesce(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity < 50 END, true)) AS ok FROM lineitem GROUP BY 1")
def d12(spark: SparkSession, d: str) -> DataFrame:
    return catalog.intact(table(spark, d, "lineitem").withColumn("flag", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity") < 50)), ["l_suppkey"], "flag")


def _stream(spark: SparkSession, d: str) -> DataFrame:
    whole = table(spark, d, "events")
    return spark.readStream.schema(whole.schema).parquet(f"{d}/events.parquet*")


def _folder(spark: SparkSession, name: str) -> str:
    return scratch(spark, name)


@BOOK.add("t04_beats", "SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts) AS start, count(*) AS n, round(avg(value), 9) AS mean FROM events GROUP BY 1, 2")
def t04(spark: SparkSession, d: str) -> DataFrame:
    out = streams.drained(streams.beats(_stream(spark, d), "ts", ["event_type"], "6 hours", "40 days"), ["event_type", "w"], _folder(spark, "beats"))
    return out.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", F.round("mean", 9).alias("mean"))


@BOOK.add("t06_sliding", "WITH s AS (SELECT user_id, value, unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS start FROM events) SELECT user_id, start, count(*) AS n, max(value) AS peak FROM s GROUP BY 1, 2")
def t06(spark: SparkSession, d: str) -> DataFrame:
    out = streams.drained(streams.sliding(_stream(spark, d), "ts", ["user_id"], "24 hours", "12 hours", "40 days"), ["user_id", "w"], _folder(spark, "sliding"))
    return out.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "peak")


@BOOK.add("t05_sessions", """WITH s AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM s)
    SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM g GROUP BY user_id, g""")
def t05(spark: SparkSession, d: str) -> DataFrame:
    """A stream of all events, after which one row far ahead of them (of no user) moves the watermark on, so that all phrases are closed."""
    folder = _folder(spark, "phrases")
    whole = table(spark, d, "events")
    ahead = whole.agg((F.max("ts") + F.expr("INTERVAL 90 DAYS")).alias("ts")).select(F.lit(None).cast(whole.schema["user_id"].dataType).alias("user_id"), "ts", F.lit(0.0).alias("value"))
    ahead.where("ts is not null").write.parquet(f"{folder}/ahead")
    rows = _stream(spark, d).select("user_id", "ts", "value").unionByName(spark.readStream.schema(ahead.schema).parquet(f"{folder}/ahead*"))
    out = drained_phrases(phrases(rows, "ts", "user_id", "value", 2 * 3_600_000_000, "40 days"), folder).where("kind = 'phrase'")
    return out.select(F.col("key").alias("user_id"), F.timestamp_micros("first").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@BOOK.add("t03_accepted_once", "SELECT DISTINCT user_id FROM events")
def t03(spark: SparkSession, d: str) -> DataFrame:
    jobs = streams.accepted_once(_stream(spark, d).select("ts", "user_id"), "ts", "user_id", "40 days")
    return streams.drained(jobs, ["user_id"], _folder(spark, "jobs"), "append").select("user_id")


@BOOK.add("t07_running_distribution", "SELECT user_id, count(value) AS n, round(avg(value), 9) AS mean, round(var_pop(value) * count(value), 4) AS m2 FROM events GROUP BY 1")
def t07(spark: SparkSession, d: str) -> DataFrame:
    out = streams.drained(streams.running_distribution(_stream(spark, d), "user_id", "value"), ["user_id"], _folder(spark, "state"))
    return out.withColumns({"mean": F.round("mean", 9), "m2": F.round("m2", 4)})


def _state(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).withColumn("y", F.col("k").cast("double"))
    return robust_z(robust_z(f, "value", KEYS, "a"), "y", KEYS, "b")


@BOOK.add("w07_rarity")
def w07(spark: SparkSession, d: str) -> DataFrame:
    return rounded(kernels.rarity(_state(spark, d), KEYS, "frame_idx", ["a", "b"], 6), "rarity")


@BOOK.add("w13_k09_segments")
def w13(spark: SparkSession, d: str) -> DataFrame:
    rows = _state(spark, d).withColumns({"timestamp_ms": F.col("frame_idx") * 500, "level": F.col("value"), "score": F.col("value"), "which": F.col("y"), "valence": F.col("a"), "arousal": F.abs("b")})
    return kernels.segments(rows, KEYS, ["a", "b"])


@BOOK.add("a14_shape_summary", f"""WITH {VECTORS}, c AS (SELECT subject, count(*) AS n, list_sort(list(frame_idx))[count(*) // 2 + 1] AS cut FROM e GROUP BY 1), x AS (SELECT subject, frame_idx, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e),
    m AS (SELECT subject, n, pos, median(x) AS m, median(x) FILTER (frame_idx < cut) AS a, median(x) FILTER (frame_idx >= cut) AS b FROM x JOIN c USING (subject) GROUP BY 1, 2, 3)
    SELECT subject, n, round(max(m) FILTER (pos = 1), 6) AS first, CASE WHEN n // 2 >= 5 THEN round(sqrt(avg((a - b) * (a - b))), 6) END AS drift FROM m GROUP BY 1, 2""")
def a14(spark: SparkSession, d: str) -> DataFrame:
    out = moments.shape_summary(vectors(spark, d), ["subject"], "frame_idx", "v")
    return out.select("subject", "n", F.round(F.col("centre")[0], 6).alias("first"), F.round("drift", 6).alias("drift"))


@BOOK.add("a16_components", """WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem), c AS (SELECT l_suppkey, median(x) AS cx, median(y) AS cy, count(*) AS n FROM r GROUP BY 1),
    m AS (SELECT l_suppkey, n, cx, cy, sum((x - cx) * (x - cx)) AS a, sum((x - cx) * (y - cy)) AS b, sum((y - cy) * (y - cy)) AS d FROM r JOIN c USING (l_suppkey) GROUP BY 1, 2, 3, 4),
    v AS (SELECT *, (a + d) / 2 + sqrt((a - d) * (a - d) / 4 + b * b) AS l1 FROM m), u AS (SELECT *, (l1 - d) / sqrt((l1 - d) * (l1 - d) + b * b) AS ux, b / sqrt((l1 - d) * (l1 - d) + b * b) AS uy FROM v),
    w AS (SELECT *, CASE WHEN (CASE WHEN abs(ux) >= abs(uy) THEN ux ELSE uy END) < 0 THEN -1 ELSE 1 END AS s, CASE WHEN (CASE WHEN abs(uy) >= abs(ux) THEN -uy ELSE ux END) < 0 THEN -1 ELSE 1 END AS t FROM u)
    SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, round(s * ((x - cx) * ux + (y - cy) * uy), 4) AS first, round(t * ((y - cy) * ux - (x - cx) * uy), 4) AS second, round(l1 / (a + d), 6) AS share, round(sqrt((a + d) / n), 6) AS residual FROM r JOIN w USING (l_suppkey)""")
def a16(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.array("l_quantity", F.col("l_extendedprice") / 1000).alias("v"))
    fitted = moments.components(rows, ["l_suppkey"], "v", size=2)
    named = fitted.select("l_suppkey", F.round(F.col("explained")[0], 6).alias("share"), F.round("residual", 6).alias("residual"))
    scored = moments.component_scores(rows, fitted, ["l_suppkey"], "v").join(named, "l_suppkey")
    return scored.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("scores")[0], 4).alias("first"), F.round(F.col("scores")[1], 4).alias("second"), "share", "residual")


@BOOK.add("a18_ridge", """WITH r AS (SELECT l_suppkey, l_orderkey, l_discount * 10 AS x, l_quantity AS y1, l_tax * 100 AS y2 FROM lineitem), c AS (SELECT l_suppkey, count(*) AS n, list_sort(list(l_orderkey))[count(*) // 2 + 1] AS cut FROM r GROUP BY 1),
    g AS (SELECT l_suppkey, n, unnest([0, CASE WHEN l_orderkey < cut THEN 1 ELSE 2 END]) AS part, x, y1, y2 FROM r JOIN c USING (l_suppkey)),
    s AS (SELECT l_suppkey, n, part, count(*) AS k, avg(x) AS mx, avg(y1) AS m1, avg(y2) AS m2, var_pop(x) * count(*) AS xx, var_pop(y1) * count(*) AS v1, var_pop(y2) * count(*) AS v2, covar_pop(x, y1) * count(*) AS c1, covar_pop(x, y2) * count(*) AS c2 FROM g GROUP BY 1, 2, 3),
    f AS (SELECT *, c1 / (xx + 0.01 * n) AS s1, c2 / (xx + 0.01 * n) AS s2, m1 - mx * c1 / (xx + 0.01 * n) AS i1, m2 - mx * c2 / (xx + 0.01 * n) AS i2 FROM s)
    SELECT w.l_suppkey, w.n, round(w.i1, 6) AS i1, round(w.i2, 6) AS i2, round(w.s1, 6) AS slope, round(1 - (w.v1 - 2 * w.s1 * w.c1 + w.s1 * w.s1 * w.xx + w.v2 - 2 * w.s2 * w.c2 + w.s2 * w.s2 * w.xx) / (w.v1 + w.v2), 6) AS explained,
        CASE WHEN a.k >= 30 THEN round(sqrt(((a.i1 - b.i1) * (a.i1 - b.i1) + (a.i2 - b.i2) * (a.i2 - b.i2)) / 2), 6) END AS drift
    FROM f w LEFT JOIN f a ON a.l_suppkey = w.l_suppkey AND a.part = 1 LEFT JOIN f b ON b.l_suppkey = w.l_suppkey AND b.part = 2 WHERE w.part = 0""")
def a18(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", F.array(F.col("l_discount") * 10).alias("x"), F.array("l_quantity", F.col("l_tax") * 100).alias("y"))
    out = moments.ridge(own, ["l_suppkey"], "x", "y", "l_orderkey")
    return out.select("l_suppkey", "n", F.round(F.col("intercept")[0], 6).alias("i1"), F.round(F.col("intercept")[1], 6).alias("i2"), F.round(F.col("coefficients")[0][0], 6).alias("slope"), F.round("explained", 6).alias("explained"), F.round("drift", 6).alias("drift"))


@BOOK.add("a23_palette")
def a23(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "lineitem").select("l_suppkey", F.array("l_quantity", F.round(F.col("l_discount") * 500), F.round(F.col("l_tax") * 500)).alias("lab"))
    return centres.palette(own, ["l_suppkey"], "lab").select("l_suppkey", "chroma_at", F.round("diversity", 6).alias("diversity"))


@BOOK.add("a24_two_means")
def a24(spark: SparkSession, d: str) -> DataFrame:
    # means of cents often lie halfway between two roundings
    return centres.two_means(frames(spark, d), KEYS, "value").withColumns({n: F.round(F.col(n) + 1e-7, 4) for n in ("threshold", "low", "high")})


@BOOK.add("a30_trimmed_fit")
def a30(spark: SparkSession, d: str) -> DataFrame:
    out = kernels.trimmed_fit(table(spark, d, "lineitem"), ["l_suppkey"], ["l_quantity", "l_discount"], "l_extendedprice")
    return out.select("l_suppkey", F.round(F.col("coefficients")[0], 4).alias("slope"))
