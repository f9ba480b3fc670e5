"""Embeddings as pictures of 8 x 8 pixels and as meshes of 21 points, and frames looked up by their ordinal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import pixels
from tracewell.queries.book import FRAMES, Book, frames, table
from tracewell.sources.tables import frames_by_ordinal, manifest

BOOK = Book()


def _pictures(spark: SparkSession, d: str) -> DataFrame:
    gray = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor(128 + x * 600).cast("double"))))
    return table(spark, d, "embeddings").select("vec_id", gray.alias("p"))


_PICTURES = """q AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), g AS MATERIALIZED (SELECT vec_id, i, i // 8 AS y, i % 8 AS x, CAST(least(255, greatest(0, floor(128 + CAST(x AS DOUBLE) * 600))) AS BIGINT) AS v FROM q),
    l AS MATERIALIZED (SELECT vec_id, list(v ORDER BY i) AS p FROM g GROUP BY 1), c AS (SELECT l.vec_id, p, g.i, y, x, v FROM l JOIN g ON g.vec_id = l.vec_id)"""


def _near(dy: int, dx: int) -> str:
    """The pixel so many rows and columns away, mirrored beyond the edges."""
    return f"p[8 * (7 - abs(7 - abs(y + {dy}))) + (7 - abs(7 - abs(x + {dx}))) + 1]"


_LAPLACE = f"({_near(-1, 0)} + {_near(1, 0)} + {_near(0, -1)} + {_near(0, 1)} - 4 * v)"
_DIAGONAL = f"(2 * ({_near(-1, -1)} + {_near(-1, 1)} + {_near(1, -1)} + {_near(1, 1)}) - 8 * v)"
_SMOOTH = "(" + " + ".join(f"{(1, 4, 6, 4, 1)[a] * (1, 4, 6, 4, 1)[b]} * {_near(a - 2, b - 2)}" for a in range(5) for b in range(5)) + ") / 256.0"


def _step(axis: str, apart: int) -> str:
    """How far the smoothed pixel's neighbours are apart; one-sided at the edges."""
    return f"abs(s[i + 1 + CASE WHEN {axis} < 7 THEN {apart} ELSE 0 END] - s[i + 1 - CASE WHEN {axis} > 0 THEN {apart} ELSE 0 END]) / CASE WHEN {axis} IN (0, 7) THEN 1 ELSE 2 END"


@BOOK.add("f21_picture_stats", f"""WITH {_PICTURES}, o AS MATERIALIZED (SELECT vec_id, i, y, x, v, {_LAPLACE} AS e, {_SMOOTH} AS s FROM c), t AS (SELECT vec_id, list(s ORDER BY i) AS s FROM o GROUP BY 1),
    h AS (SELECT vec_id, median({_step('y', 8)} + {_step('x', 1)}) / 255 AS harsh FROM (SELECT o.vec_id, o.i, o.y, o.x, t.s FROM o JOIN t ON t.vec_id = o.vec_id) GROUP BY 1),
    m AS (SELECT vec_id, var_pop(e) AS blur, avg(v) / 255 AS exposure, stddev_pop(v) / 255 AS contrast, avg((v >= 250)::INT) AS clipped, avg((v <= 5)::INT) AS crushed, avg(s) FILTER (x < 4) AS l, avg(s) FILTER (x >= 4) AS r,
    avg(s) FILTER (y < 4) AS a, avg(s) FILTER (y >= 4) AS b, avg(v) FILTER (y < 2 AND x < 2) / 255 AS first_sector, avg(v) FILTER (y BETWEEN 2 AND 4 AND x BETWEEN 2 AND 4) / 255 AS middle_sector, avg(v) FILTER (y >= 5 AND x >= 5) / 255 AS last_sector FROM o GROUP BY 1)
    SELECT e.vec_id, round(blur + 1e-7, 4) AS blur, round(exposure, 6) AS exposure, round(contrast, 6) AS contrast, round(clipped, 6) AS clipped, round(crushed, 6) AS crushed, round((l - r) / (l + r + 1e-6), 6) AS light_lr, round((a - b) / (a + b + 1e-6), 6) AS light_tb,
    round(harsh + 1e-9, 6) AS light_harsh, round(first_sector, 6) AS first_sector, round(middle_sector, 6) AS middle_sector, round(last_sector, 6) AS last_sector FROM embeddings e LEFT JOIN m ON m.vec_id = e.vec_id LEFT JOIN h ON h.vec_id = e.vec_id""")
def f21(spark: SparkSession, d: str) -> DataFrame:
    own = _pictures(spark, d).select("vec_id", pixels.picture_stats(F.col("p"), F.lit(8), F.lit(8)).alias("r"))
    # readings of whole pixels can lie half way between two rounded values
    read = [(F.round(F.col("r.blur") + 1e-7, 4) if n == "blur" else F.round(F.col(f"r.{n}") + (1e-9 if n == "light_harsh" else 0.0), 6)).alias(n) for n in pixels.PICTURE]
    return own.select("vec_id", *read, *[F.round(F.col("r.sectors")[i], 6).alias(f"{n}_sector") for n, i in {"first": 0, "middle": 4, "last": 8}.items()])


@BOOK.add("f21_surface_stats", f"""WITH {_PICTURES}, o AS MATERIALIZED (SELECT vec_id, v, {_DIAGONAL} AS e, CAST(CASE WHEN i % 7 = 0 THEN 0 ELSE 1 + i % 5 END AS DOUBLE) AS w FROM c WHERE i % 7 <> 0),
    m AS (SELECT vec_id, sum(w) AS n, sum(v * w) / sum(w) AS mean, sum(e * w) / sum(w) AS middle, sum(w) FILTER (v >= 250) AS hi, sum(w) FILTER (v <= 6) AS lo FROM o GROUP BY 1),
    d AS (SELECT o.vec_id, any_value(mean) AS mean, any_value(n) AS n, any_value(hi) AS hi, any_value(lo) AS lo, sum(pow(v - mean, 2) * w) / any_value(n) AS spread, sum(pow(e - middle, 2) * w) / any_value(n) AS micro FROM o JOIN m ON m.vec_id = o.vec_id GROUP BY 1),
    b AS (SELECT o.vec_id, v, sum(w) / any_value(n) AS share FROM o JOIN m ON m.vec_id = o.vec_id GROUP BY 1, 2), h AS (SELECT vec_id, -sum(share * log2(share)) AS entropy FROM b GROUP BY 1)
    SELECT e.vec_id, round(mean, 4) AS lum, round(CASE WHEN n > 0 THEN coalesce(hi, 0) / n END, 6) AS clip_hi, round(CASE WHEN n > 0 THEN coalesce(lo, 0) / n END, 6) AS clip_lo, round(sqrt(spread) / (mean + 1e-6), 6) AS contrast, round(entropy, 6) AS entropy, round(micro, 4) AS micro
    FROM embeddings e LEFT JOIN d ON d.vec_id = e.vec_id LEFT JOIN h ON h.vec_id = e.vec_id""")
def f21_surface(spark: SparkSession, d: str) -> DataFrame:
    weights = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(i % 7 == 0, 0.0).otherwise((1 + i % 5).cast("double")))
    own = _pictures(spark, d).select("vec_id", pixels.surface_stats(F.col("p"), weights, F.lit(8), F.lit(8)).alias("r"))
    return own.select("vec_id", *[F.round(f"r.{n}", 4 if n in ("lum", "micro") else 6).alias(n) for n in pixels.SURFACE])


#: The triangles of a fan round the first of 21 points.
FAN = [(0, i, i + 1) for i in range(1, 20)]


@BOOK.add("f36_vertex_normals", """WITH q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL), f AS (SELECT vec_id, i, v[3 * i + 1] - v[1] AS ax, v[3 * i + 2] - v[2] AS ay, v[3 * i + 3] - v[3] AS az, v[3 * i + 4] - v[1] AS bx, v[3 * i + 5] - v[2] AS b_y, v[3 * i + 6] - v[3] AS bz FROM q, range(1, 20) t(i)),
    n AS MATERIALIZED (SELECT vec_id, i, ay * bz - az * b_y AS x, az * bx - ax * bz AS y, ax * b_y - ay * bx AS z FROM f), p AS (SELECT vec_id, 0 AS vertex, x, y, z FROM n UNION ALL SELECT vec_id, i, x, y, z FROM n UNION ALL SELECT vec_id, i + 1, x, y, z FROM n),
    s AS (SELECT vec_id, vertex, sum(x) AS x, sum(y) AS y, sum(z) AS z FROM p GROUP BY 1, 2), u AS (SELECT vec_id, vertex, x / (sqrt(x * x + y * y + z * z) + 1e-9) AS x, y / (sqrt(x * x + y * y + z * z) + 1e-9) AS y, z / (sqrt(x * x + y * y + z * z) + 1e-9) AS z FROM s),
    o AS (SELECT *, CASE WHEN avg(z) OVER (PARTITION BY vec_id) < 0 THEN -1 ELSE 1 END AS turn FROM u) SELECT vec_id, CAST(vertex AS INTEGER) AS vertex, round(turn * x, 6) AS x, round(turn * y, 6) AS y, round(turn * z, 6) AS z FROM o""")
def f36(spark: SparkSession, d: str) -> DataFrame:
    points = F.slice(F.col("embedding").cast("array<double>"), 1, 63)
    own = table(spark, d, "embeddings").select("vec_id", pixels.vertex_normals(FAN)(points).alias("n"))
    each = own.select("vec_id", "n", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("vertex")).where("n is not null")
    return each.select("vec_id", "vertex", *[F.round(F.element_at("n", 3 * F.col("vertex") + k), 6).alias(a) for k, a in enumerate("xyz", 1)])


@BOOK.add("s18_frames_by_ordinal", f"""WITH {FRAMES}, c AS (SELECT track_id, frame_idx, event_id, row_number() OVER (PARTITION BY track_id ORDER BY frame_idx) - 1 AS ordinal FROM f WHERE k % 3 <> 0)
    SELECT f.track_id, f.frame_idx, CAST(ordinal AS INTEGER) AS ordinal, CASE WHEN ordinal % 5 <> 4 THEN c.event_id END AS stored_event FROM f LEFT JOIN c ON c.track_id IS NOT DISTINCT FROM f.track_id AND c.frame_idx = f.frame_idx""")
def s18(spark: SparkSession, d: str) -> DataFrame:
    """Crops of some frames, every fifth of which is not in the store, asked for by all frames."""
    own = frames(spark, d)
    crops = own.where("k % 3 <> 0").withColumnRenamed("event_id", "stored_event")
    numbered = manifest(crops, ["track_id"], "frame_idx")
    stored = crops.select("track_id", "frame_idx", "stored_event").join(numbered, ["track_id", "frame_idx"]).where("ordinal % 5 <> 4").select("track_id", "ordinal", "stored_event")
    return frames_by_ordinal(own.select("track_id", "frame_idx"), numbered, stored, ["track_id"], "frame_idx")
