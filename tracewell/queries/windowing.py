"""Window and time-series queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.numbers import mean_of
from tracewell.operators import windows as W
from tracewell.plans.readings import identity_deviation
from tracewell.queries.book import CENTRES, FRAMES, VECTORS, Book, frames, rounded, vectors

BOOK = Book()
KEYS = ["track_id"]
_OVER = "OVER (PARTITION BY track_id ORDER BY frame_idx"


@BOOK.add("w01_rolling_median", f"WITH {FRAMES} SELECT track_id, frame_idx, round(quantile_cont(value, 0.5) {_OVER} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS med FROM f")
def w01(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).select("track_id", "frame_idx", F.round(W.rolling_median(F.col("value"), KEYS, "frame_idx"), 6).alias("med"))


_GRADIENT = f"""CASE WHEN lag(1) {_OVER}) IS NULL THEN lead(value) {_OVER}) - value WHEN lead(1) {_OVER}) IS NULL THEN value - lag(value) {_OVER})
    ELSE (lead(value) {_OVER}) - lag(value) {_OVER})) / 2 END"""


@BOOK.add("w02_gradient", f"WITH {FRAMES} SELECT track_id, frame_idx, round({_GRADIENT}, 6) AS g FROM f")
def w02(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).select("track_id", "frame_idx", F.round(W.gradient(F.col("value"), KEYS, "frame_idx"), 6).alias("g"))


@BOOK.add("w03_fill_median", f"WITH {FRAMES} SELECT track_id, frame_idx, round(coalesce(CASE WHEN k % 4 <> 0 THEN value END, median(CASE WHEN k % 4 <> 0 THEN value END) OVER (PARTITION BY track_id)), 6) AS x FROM f")
def w03(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).select("track_id", "frame_idx", F.round(W.filled(F.when(F.col("k") % 4 != 0, F.col("value")), KEYS), 6).alias("x"))


_Z = f"""WITH {FRAMES}, a AS (SELECT *, median(value) OVER (PARTITION BY track_id) AS m FROM f), b AS (SELECT *, median(abs(value - m)) OVER (PARTITION BY track_id) AS d FROM a)"""


@BOOK.add("w04_robust_z", f"{_Z} SELECT track_id, frame_idx, CASE WHEN d > 0 THEN round((value - m) / (d * 1.4826 + 1e-9), 6) END AS z, CASE WHEN d > 0 THEN round(greatest((value - m) / (d * 1.4826 + 1e-9), 0), 6) END AS zp FROM b")
def w04(spark: SparkSession, d: str) -> DataFrame:
    z = W.robust_z(frames(spark, d), "value", KEYS, "z")
    # a track without spread has no scale: NULL
    z = z.withColumn("m", F.median("value").over(W.whole(KEYS))).withColumn("d", F.median(F.abs(F.col("value") - F.col("m"))).over(W.whole(KEYS)))
    z = z.withColumn("z", F.when(F.col("d") > 0, F.col("z")))
    return rounded(z.select("track_id", "frame_idx", "z", F.when(F.col("z").isNotNull(), F.greatest("z", F.lit(0.0))).alias("zp")), "z", "zp")


@BOOK.add("w05_state_scale", f"""WITH {FRAMES}, g AS (SELECT track_id, frame_idx, CASE WHEN k % 5 <> 0 THEN value END AS x FROM f), a AS (SELECT *, median(x) OVER (PARTITION BY track_id) AS m FROM g),
    b AS (SELECT *, coalesce(x, m) AS y FROM a), c AS (SELECT *, median(abs(y - m)) OVER (PARTITION BY track_id) AS d FROM b) SELECT track_id, frame_idx, CASE WHEN d > 0 THEN round(coalesce((y - m) / (d + 1e-9), 0), 6) END AS x FROM c""")
def w05(spark: SparkSession, d: str) -> DataFrame:
    own = frames(spark, d).select("track_id", "frame_idx", F.when(F.col("k") % 5 != 0, F.col("value")).alias("x"))
    own = own.withColumn("m", F.median("x").over(W.whole(KEYS)))
    own = own.withColumn("d", F.median(F.abs(F.coalesce("x", "m") - F.col("m"))).over(W.whole(KEYS)))
    scaled = W.state_scaled(own, ["x"], KEYS).withColumn("x", F.when(F.col("d") > 0, F.col("x")))
    return rounded(scaled.select("track_id", "frame_idx", "x"), "x")


@BOOK.add("w06_minmax", f"WITH {FRAMES} SELECT track_id, frame_idx, round((value - min(value) OVER (PARTITION BY track_id)) / (max(value) OVER (PARTITION BY track_id) - min(value) OVER (PARTITION BY track_id) + 1e-9), 6) AS u FROM f")
def w06(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).select("track_id", "frame_idx", F.round(W.minmax(F.col("value"), KEYS), 6).alias("u"))


@BOOK.add("w08_boxcar", f"WITH {FRAMES} SELECT track_id, frame_idx, round(sum(value) {_OVER} ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING) / 12, 6) AS s FROM f")
def w08(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).select("track_id", "frame_idx", F.round(W.boxcar(F.col("value"), KEYS, "frame_idx", 12), 6).alias("s"))


@BOOK.add("w09_runs_by_gap", f"""WITH {FRAMES}, o AS (SELECT track_id, frame_idx, CASE WHEN frame_idx - lag(frame_idx) {_OVER}) <= 2 THEN 0 ELSE 1 END AS new FROM f WHERE value > 40),
    g AS (SELECT *, sum(new) {_OVER} ROWS UNBOUNDED PRECEDING) AS run FROM o) SELECT track_id, min(frame_idx) AS first, max(frame_idx) AS last, count(*) AS n FROM g GROUP BY track_id, run HAVING count(*) >= 3""")
def w09(spark: SparkSession, d: str) -> DataFrame:
    return W.runs(frames(spark, d), F.col("value") > 40, KEYS, "frame_idx", gap=2, least=3).drop("run")


@BOOK.add("w09_sustained", f"""WITH {FRAMES}, o AS (SELECT track_id, frame_idx, CASE WHEN frame_idx - lag(frame_idx) {_OVER}) <= 2 THEN 0 ELSE 1 END AS new FROM f WHERE value > 40),
    g AS (SELECT *, sum(new) {_OVER} ROWS UNBOUNDED PRECEDING) AS run FROM o), h AS (SELECT track_id, frame_idx, count(*) OVER (PARTITION BY track_id, run) AS n FROM g)
    SELECT f.track_id, f.frame_idx, coalesce(n >= 3, false) AS held FROM f LEFT JOIN h USING (track_id, frame_idx)""")
def w09_sustained(spark: SparkSession, d: str) -> DataFrame:
    return W.in_sustained_run(frames(spark, d), F.col("value") > 40, KEYS, "frame_idx", "held").select("track_id", "frame_idx", "held")


@BOOK.add("w10_runs_by_row", f"""WITH {FRAMES}, o AS (SELECT track_id, event_id, value, row_number() OVER (PARTITION BY track_id ORDER BY event_id) AS n FROM f),
    g AS (SELECT *, n - row_number() OVER (PARTITION BY track_id ORDER BY event_id) AS g FROM o WHERE value < 60) SELECT track_id, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM g GROUP BY track_id, g HAVING count(*) >= 3""")
def w10(spark: SparkSession, d: str) -> DataFrame:
    return W.row_runs(frames(spark, d), F.col("value") < 60, KEYS, "event_id")


@BOOK.add("w11_first_sustained", f"""WITH {FRAMES}, h AS (SELECT track_id, frame_idx, min(CAST(value > 30 AS INT)) {_OVER} ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS ok, count(*) {_OVER} ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS n FROM f)
    SELECT track_id, min(frame_idx) AS start FROM h WHERE ok = 1 AND n = 4 GROUP BY 1""")
def w11(spark: SparkSession, d: str) -> DataFrame:
    return W.first_sustained(frames(spark, d), F.col("value") > 30, KEYS, "frame_idx", 4)


@BOOK.add("w12_peaks", f"WITH {FRAMES}, p AS (SELECT *, value >= lag(value) {_OVER}) AND value >= lead(value) {_OVER}) AS peak FROM f) SELECT track_id, frame_idx, value FROM p WHERE peak")
def w12(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).withColumn("peak", W.is_peak(F.col("value"), KEYS, "frame_idx")).where("peak").select("track_id", "frame_idx", "value")


@BOOK.add("w14_burn_in", f"""WITH {FRAMES}, a AS (SELECT *, row_number() {_OVER}) AS n, event_type <> 'signup' AS ride FROM f), b AS (SELECT *, min(CASE WHEN ride THEN n END) OVER (PARTITION BY track_id) AS first FROM a)
    SELECT track_id, frame_idx, CASE WHEN ride AND n >= first + 5 THEN value END AS x FROM b""")
def w14(spark: SparkSession, d: str) -> DataFrame:
    return W.burnt_in(frames(spark, d), "value", F.col("event_type") != "signup", KEYS, "frame_idx", 5, "x").select("track_id", "frame_idx", "x")


_SOME = "CASE WHEN k % 3 <> 0 THEN value END"


@BOOK.add("w15_percentile_rank", f"""WITH {FRAMES}, g AS (SELECT track_id, frame_idx, {_SOME} AS x FROM f)
    SELECT track_id, frame_idx, CASE WHEN x IS NOT NULL THEN round(cume_dist() OVER (PARTITION BY track_id, x IS NULL ORDER BY x) * 100, 6) END AS p FROM g""")
def w15(spark: SparkSession, d: str) -> DataFrame:
    own = frames(spark, d).withColumn("x", F.when(F.col("k") % 3 != 0, F.col("value")))
    return own.select("track_id", "frame_idx", F.round(W.percentile_rank(F.col("x"), KEYS), 6).alias("p"))


@BOOK.add("w16_w17_unit_ranks", f"""WITH {FRAMES}, g AS (SELECT track_id, frame_idx, value, {_SOME} AS x FROM f), r AS (SELECT track_id, frame_idx, x,
    (row_number() OVER (PARTITION BY track_id ORDER BY x NULLS LAST, frame_idx) - 1) / greatest(count(*) OVER (PARTITION BY track_id) - 1, 1) AS a,
    1 - (row_number() OVER (PARTITION BY track_id ORDER BY value NULLS LAST, frame_idx) - 1) / greatest(count(*) OVER (PARTITION BY track_id) - 1, 1) AS b FROM g)
    SELECT track_id, frame_idx, round(a, 6) AS a, round(b, 6) AS b, round((coalesce(CASE WHEN x IS NOT NULL THEN a END, 0) + b) / (CASE WHEN x IS NOT NULL THEN 2 ELSE 1 END), 6) AS mean FROM r""")
def w16(spark: SparkSession, d: str) -> DataFrame:
    own = frames(spark, d).withColumn("x", F.when(F.col("k") % 3 != 0, F.col("value")))
    own = own.withColumns({"a": W.unit_rank(F.col("x"), KEYS, "frame_idx"), "b": W.unit_rank(F.col("value"), KEYS, "frame_idx", flip=True)})
    own = own.withColumn("mean", mean_of([F.when(F.col("x").isNotNull(), F.col("a")), F.col("b")]))
    return rounded(own.select("track_id", "frame_idx", "a", "b", "mean"), "a", "b", "mean")


_STEP = "sqrt(list_sum(list_transform(list_zip(v, {o}), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"
_SEEN = "OVER (PARTITION BY subject ORDER BY frame_idx)"


@BOOK.add("w18_vector_step", f"""WITH {VECTORS}, p AS (SELECT subject, frame_idx, v, lag(v) {_SEEN} AS b, lead(v) {_SEEN} AS a FROM e)
    SELECT subject, frame_idx, round(coalesce(CASE WHEN b IS NOT NULL THEN {_STEP.format(o='b')} END, CASE WHEN a IS NOT NULL THEN {_STEP.format(o='a')} END), 6) AS step FROM p""")
def w18(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).select("subject", "frame_idx", F.round(W.vector_step(F.col("v"), ["subject"], "frame_idx"), 6).alias("step"))


@BOOK.add("w19_identity_deviation", f"""WITH {VECTORS}, u AS (SELECT subject, frame_idx, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM e), {CENTRES.replace('FROM e)', 'FROM u)')}
    SELECT u.subject, frame_idx, round(1 - list_cosine_similarity(u.v, c.c), 6) AS iddev FROM u JOIN c ON c.subject = u.subject""")
def w19(spark: SparkSession, d: str) -> DataFrame:
    return identity_deviation(vectors(spark, d), ["subject"], "v").select("subject", "frame_idx", F.round("iddev", 6).alias("iddev"))


@BOOK.add("w21_seams", f"WITH {FRAMES}, s AS (SELECT track_id, frame_idx, lag(event_type) {_OVER}) AS before, event_type AS after, frame_idx - lag(frame_idx) {_OVER}) AS gap FROM f) SELECT * FROM s WHERE before <> after")
def w21(spark: SparkSession, d: str) -> DataFrame:
    return W.seams(frames(spark, d), "event_type", KEYS, "frame_idx")


@BOOK.add("w22_absences", """WITH s AS (SELECT l_orderkey, l_linenumber AS n, lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS m FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))
    SELECT l_orderkey, n + 1 AS first, m - 1 AS last, m - n - 1 AS n FROM s WHERE m - n > 1""")
def w22(spark: SparkSession, d: str) -> DataFrame:
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber").distinct()
    return W.absences(lines, ["l_orderkey"], "l_linenumber")


@BOOK.add("w23_difference", f"WITH {FRAMES} SELECT track_id, frame_idx, round(value - coalesce(lag(value) {_OVER}), 0), 6) AS x FROM f")
def w23(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).select("track_id", "frame_idx", F.round(W.difference(F.col("value"), KEYS, "frame_idx"), 6).alias("x"))
