"""Tables and nested records that are replaced as a whole: a reader sees the old version or the new one, never a part.

A version is written to a folder of its own, then named by a small file under the version's number, which the file system creates only if it is not there yet. That file is
the commit: a writer that dies before it leaves the old version in force, and of two writers that started from the same version one is refused.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tracewell.sources.tables import exists, file_system


class Conflict(RuntimeError):
    """Another writer has committed since the version that this one started from."""


def _versions(spark: SparkSession, path: str) -> dict[int, str]:
    """Number and data folder of each version; a commit file whose line is not whole yet is none."""
    files, own = file_system(spark, f"{path}/versions")
    if not files.exists(own):
        return {}
    found = {}
    for status in files.listStatus(own):
        stream = files.open(status.getPath())
        try:
            line = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        if line.endswith("\n"):
            found[int(status.getPath().getName())] = line.strip()
    return found


def version(spark: SparkSession, path: str) -> int:
    """The number of the version in force, 0 where there is none."""
    return max(_versions(spark, path), default=0)


def publish(df: DataFrame, path: str, form: str = "parquet", after: int | None = None, keep: int = 2) -> int:
    """Put df in place as the next version and return its number. df may read the version in force.

    after: the version that df was made from (the one in force, if None); Conflict if another has come since. Structs, arrays and maps go as they are, so with
    form "json" a row is a nested record on a line. The last `keep` versions stay for readers that have begun; older ones are removed.
    """
    spark = df.sparkSession
    after = version(spark, path) if after is None else after
    name = f"{after + 1:012d}-{uuid.uuid4().hex}"
    df.write.format(form).save(f"{path}/data/{name}")
    files, commit = file_system(spark, f"{path}/versions/{after + 1:012d}")
    try:
        out = files.create(commit, False)
    except Py4JJavaError as error:
        if not files.exists(commit):
            raise
        files.delete(file_system(spark, f"{path}/data/{name}")[1], True)
        raise Conflict(f"version {after + 1} of {path} is another writer's") from error
    try:
        out.write(bytearray(f"{name}\n", "utf-8"))
    finally:
        out.close()
    for number, folder in _versions(spark, path).items():
        if number <= after + 1 - keep:
            files.delete(file_system(spark, f"{path}/versions/{number:012d}")[1], False)
            files.delete(file_system(spark, f"{path}/data/{folder}")[1], True)
    return after + 1


def read_published(spark: SparkSession, path: str, schema: T.StructType | str, form: str = "parquet") -> DataFrame:
    """The version in force, or an empty table where none is; broken JSON fails, as a version is whole."""
    held = _versions(spark, path)
    if not held or not exists(spark, f"{path}/data/{held[max(held)]}"):
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema)
    return (reader.option("mode", "FAILFAST") if form == "json" else reader).format(form).load(f"{path}/data/{held[max(held)]}")
