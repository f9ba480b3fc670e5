"""Session settings and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key that holds over 1 / HOT_PART of all rows is hot, so there are fewer than HOT_PART hot keys. Their rows are dealt over SALTS parts.
HOT_PART, SALTS = 256, 64
#: A shuffle of few rows has so many partitions, or the session's number if that is smaller.
FEW_PARTITIONS = 8

_folders: dict[str, SparkSession] = {}


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions_for(rows: DataFrame, size: Column, share: int) -> int:
    """Partitions of about `share` bytes by the sum of `size`; the session's number at least."""
    total = rows.agg(F.sum(size).alias("n")).first()["n"] or 0
    return max(shuffle_partitions(rows.sparkSession), -(-int(total) // share))


@contextmanager
def shuffles_for(spark: SparkSession, rows: int, share: int = 100_000) -> Iterator[None]:
    """Jobs run inside shuffle into one partition for each `share` of so many rows, FEW_PARTITIONS at least, whatever the session's number."""
    setting = "spark.sql.shuffle.partitions"
    session = spark.conf.get(setting)
    spark.conf.set(setting, str(max(min(int(session), FEW_PARTITIONS), -(-rows // share))))
    try:
        yield
    finally:
        spark.conf.set(setting, session)


def give_back(spark: SparkSession) -> None:
    """Ask the executors to collect their garbage, so that their heaps shrink before Python workers need the room."""
    n = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def hot_values(counted: DataFrame, key: str, n: str, total: int | None = None) -> list:
    """The keys (one a row of `counted`, with n rows each) that hold over 1 / HOT_PART of all rows (their `total`, if known): fewer than HOT_PART of them."""
    if total is None:
        total = counted.agg(F.sum(n).alias("n")).first()["n"] or 0
    return [r[0] for r in counted.where(F.col(n) * HOT_PART > F.lit(total)).select(key).collect()]


def spread_join(many: DataFrame, few: DataFrame, key: str, hot: list, by: str) -> DataFrame:
    """many join few (one row a key) on key, neither broadcast; rows of hot keys are dealt over SALTS parts by a hash of `by`, with a copy of few's row in each."""
    if not hot:
        return many.join(few.hint("merge"), key)
    is_hot = F.col(key).isin(hot)
    salted = many.withColumn("__salt", F.when(is_hot, F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).otherwise(0))
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(few.withColumn("__salt", F.explode(salts)).hint("merge"), [key, "__salt"]).drop("__salt")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset (tests, local mode), one beside the warehouse."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    import tempfile

    return f"file://{tempfile.gettempdir()}/tracewell-checkpoints"


def _forget(folder: str) -> None:
    spark = _folders.pop(folder)
    if spark.sparkContext._jsc is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _forget_all() -> None:
    for folder in list(_folders):
        try:
            _forget(folder)
        except Exception:  # the JVM may have gone first; the folder is named after the application
            pass


def new_path(spark: SparkSession, name: str) -> str:
    """A path that is not yet taken, in the folder of this application."""
    folder = f"{shared_folder(spark)}/tracewell/{spark.sparkContext.applicationId}"
    _folders[folder] = spark
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it back.

    A lost executor then costs a reread, not a recomputation, and two readers see the same rows.
    The files live in one folder per application, removed when the driver ends.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out._tracewell_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove the files of written() tables that nothing will read again."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._tracewell_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
