"""Bounded samples of labelled rows, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of a label whose texts are ranked before the label's are.
_PARTS = 64
#: The hashes of so many texts are broadcast, those of more are joined by a shuffle.
_BROADCAST = 100_000
#: Different labels that a classifier may have.
LABELS = 10_000


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of doc_id as text, modulo folds; -1 for a null doc_id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)).cast("int"), F.lit(-1))


def bounded(rows: DataFrame, label: str, most: int) -> DataFrame:
    """The `most` different texts of each label with the least hashes (all, where there are fewer); rows: label and text.

    Rows are made distinct by label and 128 bits of hash of the text before they are ranked, without their texts, so a group of copies of any size is one row of
    the sample, and a label whose texts all repeat is learned as any other. Labels are ranked in parts first: no task orders more than `most` rows a part. The hash
    decides, so a rerun takes the same texts. Over LABELS labels are an error, not a sample.
    """
    known = rows.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.xxhash64(F.lit("sample"), "text").alias("h"), F.xxhash64("text").alias("h2"), "text")
    labels = known.groupBy("label").count().limit(LABELS + 1).count()
    if labels > LABELS:
        raise ValueError(f"over {LABELS} different labels in {label}")
    rank = lambda *by: F.row_number().over(Window.partitionBy("label", *by).orderBy("h", "h2"))
    least = known.select("label", "h", "h2").distinct().withColumn("part", F.pmod("h2", F.lit(_PARTS)))
    least = least.withColumn("rank", rank("part")).where(F.col("rank") <= most).withColumn("rank", rank()).where(F.col("rank") <= most).select("label", "h", "h2")
    small = labels * most <= _BROADCAST  # rows of a label and 16 bytes
    drawn = known.join(F.broadcast(least) if small else least.hint("merge"), ["label", "h", "h2"], "left_semi")
    return drawn.groupBy("label", "h", "h2").agg(F.first("text").alias("text")).select(F.col("label").alias(label), "text")
