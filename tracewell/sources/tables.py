"""Reading and writing frame tables, JSON records and logs under a root that any Hadoop file system can hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.sources.schemas import conformed, schema, without_nan


def file_system(spark: SparkSession, path: str) -> tuple:
    """(Hadoop file system, Hadoop path)."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()), own


def exists(spark: SparkSession, path: str) -> bool:
    files, own = file_system(spark, path)
    return files.exists(own)


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A required table; clips are partitions, so a filter on clip_id reads their folders only."""
    return without_nan(spark.read.schema(schema(table)).parquet(f"{root}/{table}"))


def read_optional(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The table, or an empty one of its schema where it does not exist, so that left joins give NULL."""
    return read_table(spark, root, table) if exists(spark, f"{root}/{table}") else spark.createDataFrame([], schema(table))


def write_table(df: DataFrame, root: str, table: str) -> None:
    """Checked against the schema; replaces the clips that df holds and leaves the others."""
    conformed(df, table).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("clip_id").parquet(f"{root}/{table}")


def read_records(spark: SparkSession, path: str, layout: T.StructType, lines: bool = True, broken: str | None = None) -> DataFrame:
    """JSON records, one a line (blank lines are passed over) or one a file; no file gives an empty table.

    Broken lines are passed over, unless `broken` names a column for them: it then holds the line as it is, and NULL for whole ones, so that they can be counted.
    """
    if broken is not None:
        layout = T.StructType([*layout.fields, T.StructField(broken, T.StringType())])
    if not exists(spark, path):
        return spark.createDataFrame([], layout)
    reader = spark.read.schema(layout)
    if not lines:
        return reader.option("multiLine", True).json(path)
    if broken is None:
        return reader.option("mode", "DROPMALFORMED").json(path)
    return reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", broken).json(path)


def append_records(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_log(df: DataFrame, root: str) -> None:
    """Candidate records by clip and product: rewriting a product's rows leaves the others alone."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("clip_id", "product").json(f"{root}/candidates")


def latest(rows: DataFrame, keys: list[str], time: str, sequence: str, flag: str) -> DataFrame:
    """The last row of each key by (time, sequence); keys whose last flag is NULL are gone."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(time), F.desc(sequence)))
    return rows.withColumn("__n", n).where(f"__n = 1 and {flag} is not null").drop("__n")


def upsert(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], time: str, sequence: str, flag: str) -> int:
    """latest() of the published version and of what is new, as the next version: its number. Conflict where another writer came between."""
    from tracewell.sources.published import publish, read_published, version

    before = version(spark, path)
    old = read_published(spark, path, rows.schema)
    return publish(latest(old.unionByName(rows), keys, time, sequence, flag), path, after=before)


def manifest(rows: DataFrame, keys: list[str], order: str, least: int = 0) -> DataFrame:
    """keys, ordinal, order: the frames of each subject numbered from 0; subjects of fewer than `least` frames are left out."""
    w = Window.partitionBy(*keys)
    out = rows.select(*keys, order, (F.row_number().over(w.orderBy(order)) - 1).alias("ordinal"), F.count("*").over(w).alias("__n"))
    return out.where(F.col("__n") >= least).drop("__n")


def frames_by_ordinal(wanted: DataFrame, numbered: DataFrame, stored: DataFrame, keys: list[str], frame: str) -> DataFrame:
    """wanted, the ordinal of each row's frame, and what is stored there; NULL where the manifest lacks the frame or the store lacks the ordinal.

    numbered is a manifest() (keys, ordinal, frame), stored has keys, ordinal and columns that wanted has not; both are unique by their places. Every wanted row comes back once, repeated
    ones too, and null keys are keys. Two exchanges, by frame and by ordinal, so that no subject is gathered.
    """
    extra = [c for c in stored.columns if c not in (*keys, "ordinal")]
    clash = {*extra, "ordinal"} & set(wanted.columns)
    if clash:
        raise ValueError(f"wanted has columns of the store: {sorted(clash)}")

    def joined(left: DataFrame, right: DataFrame, on: list[str], bring: list[str]) -> DataFrame:
        place = {c: i for i, c in enumerate(left.columns)}
        left = left.toDF(*[f"__l_{i}" for i in place.values()])
        right = right.select(*[F.col(f"`{c}`").alias(f"__r_{i}") for i, c in enumerate(on)], *[F.col(f"`{c}`").alias(f"__b_{i}") for i, c in enumerate(bring)])
        same = [F.col(f"__l_{place[c]}").eqNullSafe(F.col(f"__r_{i}")) for i, c in enumerate(on)]
        return left.join(right, same, "left").select(*[F.col(f"__l_{i}").alias(c) for c, i in place.items()], *[F.col(f"__b_{i}").alias(c) for i, c in enumerate(bring)])

    at = joined(wanted, numbered, [*keys, frame], ["ordinal"])
    return joined(at, stored.where("ordinal is not null"), [*keys, "ordinal"], extra)


def provenance(spark: SparkSession, path: str, origin: str) -> DataFrame:
    """path, bytes, modified, sha256, origin of each file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"), F.lit(origin).alias("origin"))


def first_seen(known: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """known and those of found whose key is new: what was first recorded stays."""
    return known.unionByName(found.join(known.select(key), key, "left_anti"))
