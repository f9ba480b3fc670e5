"""Face readings, the catalog over a graph of suppliers, lookups, and twins of the kernels that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import readers as R
from tracewell.functions.numbers import balanced_pair
from tracewell.plans import catalog, subjects
from tracewell.queries.book import FRAMES, SIGNALS, VECTORS, Book, rounded, signals, table, vectors

BOOK = Book()


def _at(i: int) -> str:
    return f"v[{i % 64 + 1}]"


def _apart(a: int, b: int, axes: int) -> str:
    return "sqrt(" + " + ".join(f"pow({_at(3 * a + i)} - {_at(3 * b + i)}, 2)" for i in range(axes)) + ")"


@BOOK.add("f09_rotation", f"""WITH {VECTORS} SELECT frame_idx, round(degrees(atan2(-v[7], sqrt(v[1] * v[1] + v[4] * v[4]))), 6) AS yaw, round(degrees(atan2(v[8], v[9])), 6) AS pitch, round(degrees(atan2(v[4], v[1])), 6) AS roll,
    round(-degrees(atan2(-v[7], sqrt(v[1] * v[1] + v[4] * v[4]))), 6) AS yaw_m, round(-degrees(atan2(v[8], v[9])), 6) AS pitch_m, round(-degrees(atan2(v[4], v[1])), 6) AS roll_m FROM e""")
def f09(spark: SparkSession, d: str) -> DataFrame:
    angles = [*R.rotation_angles(F.col("v")), *R.rotation_angles(F.col("v"), mirrored=True)]
    return vectors(spark, d).select("frame_idx", *[F.round(x, 6).alias(n) for x, n in zip(angles, ("yaw", "pitch", "roll", "yaw_m", "pitch_m", "roll_m"))])


@BOOK.add("f10_f12_expression", f"""WITH {VECTORS} SELECT frame_idx, round(greatest(v[10], v[11]), 9) AS blink, round(greatest(v[43], v[44]), 9) AS smile, round(v[26], 9) AS jaw,
    round(greatest(list_max(v[2:11]), list_max(v[20:52])), 9) AS expression FROM e""")
def f10(spark: SparkSession, d: str) -> DataFrame:
    w = F.col("v")
    made = {"blink": R.greater_side(w, R.BLINK), "smile": R.greater_side(w, R.SMILE), "jaw": R.dim(w, R.JAW), "expression": R.expression(w)}
    return vectors(spark, d).select("frame_idx", *[F.round(x, 9).alias(n) for n, x in made.items()])


_PUPILS = " + ".join(f"{_apart(*lids, 2)} / (({_apart(*a, 2)} + {_apart(*b, 2)}) / 2 + 1e-9)" for lids, (a, b) in zip(R.LIDS, R.IRIS))
_OPEN = " + ".join(f"{_apart(*lids, 3)} / ({_apart(*corners, 3)} + 1e-9)" for lids, corners in zip(R.LIDS, R.CORNERS))
_SIDES = [f"(abs({_at(3 * c)} - {_at(3 * R.NOSE)}) + 1e-9)" for c in R.CHEEKS]


@BOOK.add("f15_face_signals", f"WITH {VECTORS} SELECT frame_idx, round(({_PUPILS}) / 2, 6) AS pupil, round(abs(ln({_SIDES[0]} / {_SIDES[1]})), 6) AS frontality, round(({_OPEN}) / 2, 6) AS openness FROM e")
def f15(spark: SparkSession, d: str) -> DataFrame:
    own = vectors(spark, d).withColumn("p", F.flatten(F.array_repeat("v", 23)))
    p = F.col("p")
    return own.select("frame_idx", F.round(R.pupil_visibility(p), 6).alias("pupil"), F.round(R.frontality(p), 6).alias("frontality"), F.round(R.eye_openness(p), 6).alias("openness"))


@BOOK.add("f23_balanced_pairs", "SELECT l_orderkey, l_linenumber, round(CASE WHEN abs(l_quantity / 50 - l_discount * 10) > 0.55 THEN CASE WHEN abs(l_quantity / 50 - 0.5) <= abs(l_discount * 10 - 0.5) THEN l_quantity / 50 ELSE l_discount * 10 END ELSE (l_quantity / 50 + l_discount * 10) / 2 END, 6) AS x FROM lineitem")
def f23(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(balanced_pair(F.col("l_quantity") / 50, F.col("l_discount") * 10), 6).alias("x"))


@BOOK.add("j04_tubelets", f"""WITH {SIGNALS}, r AS (SELECT s_suppkey AS subject, CASE WHEN s_nationkey % 2 = 0 THEN 'main' ELSE 'aux' END AS role FROM supplier WHERE s_nationkey % 3 <> 0),
    p AS (SELECT DISTINCT frame_idx, CASE WHEN frame_idx < 40 THEN 'boarding' ELSE 'ride' END AS phase FROM s WHERE frame_idx % 5 <> 4),
    t AS (SELECT s.track_id, s.frame_idx, track_id AS subject, role, coalesce(phase, 'ride') AS scene_phase FROM s JOIN r ON r.subject = s.track_id LEFT JOIN p ON p.frame_idx = s.frame_idx)
    SELECT track_id, frame_idx, role, scene_phase, CAST(round_even(frame_idx / 30.0 * 1000, 0) AS BIGINT) AS timestamp_ms FROM t WHERE subject IN (SELECT subject FROM t WHERE scene_phase = 'ride')""")
def j04(spark: SparkSession, d: str) -> DataFrame:
    rows = signals(spark, d).select(F.lit(1).alias("clip"), "track_id", "frame_idx")
    names = rows.select("clip", "track_id", F.col("track_id").alias("subject")).distinct()
    roles = table(spark, d, "supplier").where("s_nationkey % 3 <> 0").select(F.lit(1).alias("clip"), F.col("s_suppkey").alias("subject"), F.when(F.col("s_nationkey") % 2 == 0, "main").otherwise("aux").alias("role"))
    phases = rows.where("frame_idx % 5 <> 4").select("clip", "frame_idx", F.when(F.col("frame_idx") < 40, "boarding").otherwise("ride").alias("scene_phase")).distinct()
    return subjects.tubelets(rows, names, roles, phases, "clip", "frame_idx", "track_id").select("track_id", "frame_idx", "role", "scene_phase", "timestamp_ms")


def _analyses(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as analyses: each makes one artifact and reads those of the suppliers of half and a third of its number."""
    k = F.col("s_suppkey")
    reads = F.array_distinct(F.filter(F.array(F.floor(k / 2), F.floor(k / 3)), lambda x: x > 0))
    return table(spark, d, "supplier").select(F.concat(F.lit("s"), k).alias("analysis"), F.transform(reads, lambda x: F.concat(F.lit("m"), x)).alias("reads"), F.array(F.concat(F.lit("m"), k)).alias("makes"))


_EDGES = "g AS (SELECT s_suppkey AS k, s_suppkey // 2 AS up FROM supplier WHERE s_suppkey // 2 > 0 UNION SELECT s_suppkey, s_suppkey // 3 FROM supplier WHERE s_suppkey // 3 > 0)"


@BOOK.add("d02_levels", f"WITH RECURSIVE {_EDGES}, p(k, level) AS (SELECT s_suppkey, 0 FROM supplier UNION SELECT g.k, p.level + 1 FROM p JOIN g ON g.up = p.k), m AS (SELECT k, max(level) AS level FROM p GROUP BY 1) SELECT 's' || k AS analysis, level, CAST(row_number() OVER (ORDER BY level, 's' || k) AS INTEGER) AS place FROM m")
def d02(spark: SparkSession, d: str) -> DataFrame:
    return catalog.numbered(_analyses(spark, d))


@BOOK.add("d03_closure", f"WITH RECURSIVE {_EDGES}, n(k) AS (SELECT s_suppkey FROM supplier WHERE s_suppkey IN (7, 10) UNION SELECT g.up FROM n JOIN g ON g.k = n.k) SELECT 's' || k AS analysis, CASE WHEN k IN (7, 10) THEN 'final' WHEN k = 1 THEN 'input' ELSE 'intermediate' END AS role FROM n")
def d03(spark: SparkSession, d: str) -> DataFrame:
    return catalog.closure(spark, _analyses(spark, d), ["m7", "m10"])


@BOOK.add("d04_rule_drift", "SELECT 's' || s_suppkey AS analysis, 'm' || (2 * s_suppkey) AS artifact FROM supplier WHERE 2 * s_suppkey NOT IN (SELECT s_suppkey FROM supplier)")
def d04(spark: SparkSession, d: str) -> DataFrame:
    return catalog.unresolved_reads(_analyses(spark, d).withColumn("reads", F.array(F.concat(F.lit("m"), (F.substring("analysis", 2, 20).cast("long") * 2)))))


@BOOK.add("d08_edges", f"WITH {_EDGES} SELECT 's' || up AS upstream, 's' || k AS analysis, 'm' || up AS artifact FROM g")
def d08(spark: SparkSession, d: str) -> DataFrame:
    return catalog.edges(_analyses(spark, d))


# twins of queries in the other modules
_T = "OVER (PARTITION BY track_id)"
_STATE = f"""{FRAMES}, z1 AS (SELECT track_id, frame_idx, value, CAST(k AS DOUBLE) AS y FROM f), z2 AS (SELECT *, median(value) {_T} AS m, median(y) {_T} AS my FROM z1), z3 AS (SELECT *, median(abs(value - m)) {_T} AS d, median(abs(y - my)) {_T} AS dy FROM z2),
    z AS (SELECT track_id, frame_idx, (value - m) / (d * 1.4826 + 1e-9) AS a, (y - my) / (dy * 1.4826 + 1e-9) AS b FROM z3)"""
_SIX = "OVER (PARTITION BY track_id ORDER BY frame_idx ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING)"
BOOK.sql["w07_rarity"] = f"""WITH {_STATE}, w AS (SELECT track_id, frame_idx, avg(a) {_SIX} AS a, avg(b) {_SIX} AS b, count(*) {_SIX} AS c FROM z), v AS MATERIALIZED (SELECT *, count(*) {_T} AS n FROM w WHERE c = 6),
    p AS (SELECT x.track_id, x.frame_idx, x.n, sqrt(pow(x.a - y.a, 2) + pow(x.b - y.b, 2)) AS gap FROM v x JOIN v y ON x.track_id = y.track_id AND x.frame_idx <> y.frame_idx WHERE x.n >= 20),
    r AS (SELECT *, row_number() OVER (PARTITION BY track_id, frame_idx ORDER BY gap) AS i FROM p), o AS (SELECT track_id, frame_idx, avg(gap) AS rarity FROM r WHERE i <= greatest(5, n // 10) GROUP BY 1, 2)
    SELECT z.track_id, z.frame_idx, round(rarity, 6) AS rarity FROM z LEFT JOIN o ON o.track_id = z.track_id AND o.frame_idx = z.frame_idx"""


def _rounds(n: int) -> str:
    step = "r{i} AS MATERIALIZED (SELECT f.track_id, coalesce(avg(value) FILTER (value <= (low + high) / 2), low) AS low, coalesce(avg(value) FILTER (value > (low + high) / 2), high) AS high FROM f JOIN r{j} ON r{j}.track_id = f.track_id GROUP BY f.track_id, low, high)"
    return ", ".join(step.format(i=i, j=i - 1) for i in range(1, n + 1))


BOOK.sql["a24_two_means"] = f"""WITH {FRAMES.replace('f AS (', 'f AS MATERIALIZED (', 1)}, r0 AS (SELECT track_id, min(value) AS low, max(value) AS high FROM f GROUP BY 1), {_rounds(20)}
    SELECT track_id, round((low + high) / 2 + 1e-7, 4) AS threshold, round(low + 1e-7, 4) AS low, round(high + 1e-7, 4) AS high, high >= 1.25 * greatest(low, 1e-9) AS split FROM r20"""


def _recoloured(n: int) -> str:
    step = """n{i} AS MATERIALIZED (SELECT p.k, p.x, p.y, p.z, p.n, min({{'d': (p.x - r.x) * (p.x - r.x) + (p.y - r.y) * (p.y - r.y) + (p.z - r.z) * (p.z - r.z), 'j': r.j}}).j AS j FROM p JOIN r{h} r ON r.k = p.k GROUP BY ALL),
    r{i} AS MATERIALIZED (SELECT r.k, r.j, coalesce(sum(a.n * a.x) / sum(a.n), any_value(r.x)) AS x, coalesce(sum(a.n * a.y) / sum(a.n), any_value(r.y)) AS y, coalesce(sum(a.n * a.z) / sum(a.n), any_value(r.z)) AS z, coalesce(sum(a.n), 0) AS w FROM r{h} r LEFT JOIN n{i} a ON a.k = r.k AND a.j = r.j GROUP BY r.k, r.j)"""
    return ", ".join(step.format(i=i, h=i - 1) for i in range(1, n + 1))


BOOK.sql["a23_palette"] = f"""WITH p AS MATERIALIZED (SELECT l_suppkey AS k, l_quantity AS x, round(l_discount * 500) AS y, round(l_tax * 500) AS z, count(*) AS n FROM lineitem GROUP BY ALL),
    o AS (SELECT *, sum(n) OVER (PARTITION BY k ORDER BY x, y, z ROWS UNBOUNDED PRECEDING) AS hi, sum(n) OVER (PARTITION BY k) AS t FROM p), g AS (SELECT *, unnest([0, 1, 2, 3, 4]) AS j FROM o),
    r0 AS MATERIALIZED (SELECT k, j, x, y, z FROM g WHERE CASE WHEN j = 4 THEN t - 1 ELSE floor(j * ((t - 1) / 4)) END >= hi - n AND CASE WHEN j = 4 THEN t - 1 ELSE floor(j * ((t - 1) / 4)) END < hi), {_recoloured(15)},
    s AS (SELECT k, j, sum(w) OVER (PARTITION BY k) AS t, w / sum(w) OVER (PARTITION BY k) AS share, sqrt(y * y + z * z) AS chroma FROM r15), q AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY share DESC, j) - 1 AS place FROM s)
    SELECT k AS l_suppkey, CASE WHEN any_value(t) >= 200 THEN CAST(max({{'c': CASE WHEN share > 0.05 THEN chroma ELSE -1 END, 'p': -place}}).p * -1 AS INTEGER) END AS chroma_at, CASE WHEN any_value(t) >= 200 THEN round(-sum(share * ln(share)) FILTER (share > 0), 6) END AS diversity FROM q GROUP BY 1"""


def _fit(i: int) -> str:
    s = "SELECT l_suppkey, avg(x) AS mx, avg(w) AS mw, avg(y) AS my, var_pop(x) AS xx, var_pop(w) AS ww, covar_pop(x, w) AS xw, covar_pop(x, y) AS xy, covar_pop(w, y) AS wy FROM u{i} GROUP BY 1"
    return f"""c{i} AS MATERIALIZED (SELECT *, (xy * ww - wy * xw) / (xx * ww - xw * xw) AS b, (wy * xx - xy * xw) / (xx * ww - xw * xw) AS c FROM ({s.format(i=i)})),
    h{i} AS (SELECT u0.*, abs(my + b * (x - mx) + c * (w - mw) - y) AS gap FROM u0 JOIN c{i} USING (l_suppkey)), u{i + 1} AS MATERIALIZED (SELECT l_suppkey, x, w, y FROM (SELECT *, quantile_cont(gap, 0.75) OVER (PARTITION BY l_suppkey) AS most FROM h{i}) WHERE gap <= most)"""


BOOK.sql["a30_trimmed_fit"] = f"WITH u0 AS MATERIALIZED (SELECT l_suppkey, l_quantity AS x, l_discount AS w, l_extendedprice AS y FROM lineitem), {_fit(0)}, {_fit(1)}, {_fit(2)} SELECT l_suppkey, round(b, 4) AS slope FROM c2"

BOOK.sql["a21_separation"] = f"""WITH {VECTORS}, r AS (SELECT *, count(*) OVER (PARTITION BY subject) AS n, row_number() OVER (PARTITION BY subject ORDER BY frame_idx) AS i FROM e), x AS (SELECT subject, n, i <= n // 2 AS first, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM r),
    m AS (SELECT subject, n, pos, median(x) AS c, median(x) FILTER (first) - median(x) FILTER (NOT first) AS d FROM x GROUP BY 1, 2, 3), s AS (SELECT subject, CASE WHEN any_value(n) // 2 >= 5 THEN sqrt(avg(d * d)) END AS drift FROM m GROUP BY 1),
    p AS (SELECT a.subject AS a, b.subject AS b, sqrt(avg(pow(a.c - b.c, 2))) AS gap FROM m a JOIN m b ON a.pos = b.pos AND a.subject < b.subject GROUP BY 1, 2)
    SELECT a, b, round(gap, 6) AS gap, round(gap / nullif((x.drift + y.drift) / 2, 0), 6) AS ratio FROM p JOIN s x ON x.subject = a JOIN s y ON y.subject = b"""

BOOK.sql["q11_stitched"] = """WITH RECURSIVE t AS (SELECT label % 2 AS clip, vec_id, label * 100 + vec_id % 7 AS track, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    x AS (SELECT clip, track, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM t), m AS (SELECT clip, track, pos, avg(x) AS x FROM x GROUP BY 1, 2, 3), c AS MATERIALIZED (SELECT clip, track, list(x ORDER BY pos) AS c FROM m GROUP BY 1, 2),
    l AS MATERIALIZED (SELECT a.clip, a.track AS a, b.track AS b FROM c a JOIN c b ON a.clip = b.clip AND a.track <> b.track WHERE list_cosine_similarity(a.c, b.c) >= 0.2),
    n(clip, track, reach) AS (SELECT clip, track, track FROM c UNION SELECT n.clip, n.track, l.b FROM n JOIN l ON l.clip = n.clip AND l.a = n.reach) SELECT clip, track, min(reach) AS subject FROM n GROUP BY 1, 2"""
