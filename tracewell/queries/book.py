"""Registering queries, and the frame views that stand for recorded clips."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Book:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(run: Query) -> Query:
            self.queries[name] = run
            if sql is not None:
                self.sql[name] = sql
            return run

        return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a partition whose tracks are sorted for windows, at most on average, and those that are worth one of their own (fixed values).
MOST, LEAST = 200_000, 10_000


def parts_of(rows: DataFrame) -> int:
    """How many partitions rows are dealt over: as many as keep a task's sorts small whatever the input's size; small inputs take no more than the session says."""
    n = rows.count()
    return max(1, -(-n // MOST), min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // LEAST)))


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows by keys, over parts_of(rows) partitions."""
    return rows.repartition(parts_of(rows), *keys)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as frames: a user is a track, its events in time are its frames."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return dealt(table(spark, sf_dir, "events"), "user_id").select(
        F.col("user_id").alias("track_id"), (F.row_number().over(w) - 1).cast("long").alias("frame_idx"), "event_id", "ts", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k")
    )


#: The same view in SQL.
FRAMES = """f AS (SELECT user_id AS track_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS frame_idx, event_id, ts, event_type, value,
    CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as frames of labelled subjects."""
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("subject"), F.col("vec_id").alias("frame_idx"), F.col("embedding").cast("array<double>").alias("v"))


VECTORS = "e AS (SELECT label AS subject, vec_id AS frame_idx, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
CENTRES = """x AS (SELECT subject, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e),
    m AS (SELECT subject, pos, avg(x) AS x FROM x GROUP BY 1, 2), c AS (SELECT subject, list(x ORDER BY pos) AS c FROM m GROUP BY 1)"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a frame table with every signal of the gates, NULLs among them; a supplier is a track."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate", "l_quantity"]
    w = Window.partitionBy("l_suppkey").orderBy(*order)
    return dealt(table(spark, sf_dir, "lineitem"), "l_suppkey").withColumn("frame_idx", (F.row_number().over(w) - 1).cast("long")).selectExpr("l_suppkey AS track_id", "frame_idx", *[f"{sql} AS {name}" for name, sql in _SIGNALS.items()])


_SIGNALS = {
    "blink": "CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_discount * 8 END",
    "smile": "(l_quantity % 10) / 10",
    "jaw": "l_tax * 7",
    "mesh_yaw": "CASE WHEN l_linenumber % 7 = 0 THEN NULL ELSE l_quantity * 2 - 50.5 END",
    "wide_yaw": "CAST(l_partkey % 120 AS DOUBLE) - 60.5",
    "yaw": "CASE WHEN l_linenumber % 7 = 0 THEN NULL ELSE l_quantity - 25.5 END",
    "pitch": "CAST(l_partkey % 50 AS DOUBLE) - 25.5",
    "roll": "CAST(l_orderkey % 40 AS DOUBLE) - 20.5",
    "skin_entropy": "CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE 3.05 + (l_partkey % 40) / 10.0 END",
    "eye_lum_rel": "0.05 + (l_partkey % 20) / 10.0",
    "mouth_vis": "(l_orderkey % 30) / 1000.0 + 0.0005",
    "eyes_vis": "CAST(l_orderkey % 3 AS DOUBLE)",
    "blur": "l_extendedprice / 1000",
    "iddev": "l_discount + l_tax * 3 + 0.003",
    "em_conf": "(l_partkey % 10) / 10.0 + 0.05",
    "cos_self": "(l_orderkey % 100) / 100.0 + 0.005",
    "cos_other": "CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE (l_partkey % 100) / 100.0 + 0.0025 END",
}
SIGNALS = f"""s AS (SELECT l_suppkey AS track_id, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate, l_quantity) - 1 AS BIGINT) AS frame_idx,
    {', '.join(f'{sql} AS {name}' for name, sql in _SIGNALS.items())} FROM lineitem)"""


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})
