"""Text and key expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: "index: score" at the start of a line.
SCORE_LINE = r"(?m)^\s*(\d+)\s*[:\.\)]\s*(\d+(?:\.\d+)?)"


def bucket(x: Column, steps: Sequence[tuple[float, str]], rest: str) -> Column:
    """The name of the first step that x reaches, from the top; NULL is `rest`."""
    found = F.when(F.lit(False), F.lit(None))
    for least, name in steps:
        found = found.when(x >= least, name)
    return found.otherwise(rest)


def described(parts: Sequence[Column]) -> Column:
    """A sentence of the parts that are not NULL."""
    return F.concat(F.concat_ws(", ", *parts), F.lit("."))


def line_scores(text: Column, most: float = 10.0) -> Column:
    """Array of (index, score) read from lines such as "3: 7.5"; scores are held to [0, most]."""
    index = F.regexp_extract_all(text, F.lit(SCORE_LINE), 1)
    score = F.regexp_extract_all(text, F.lit(SCORE_LINE), 2)
    return F.zip_with(index, score, lambda i, s: F.struct(i.cast("int").alias("index"), F.least(F.lit(most), s.cast("double")).alias("score")))


def subject_query(text: Column) -> Column:
    """`seat` or `face:<path>` as (kind, path); NULL for anything else."""
    return F.when(text == "seat", F.struct(F.lit("seat").alias("kind"), F.lit(None).cast("string").alias("path"))).when(
        text.startswith("face:"), F.struct(F.lit("face").alias("kind"), F.substring(text, 6, 1 << 20).alias("path"))
    )


def source_uri(text: Column, bucket_name: str) -> Column:
    """A full URI: s3:// and file:// stay, absolute paths become file://, the rest lies in the bucket."""
    return F.when(text.startswith("s3://") | text.startswith("file://"), text).when(text.startswith("/"), F.concat(F.lit("file://"), text)).otherwise(F.concat(F.lit(f"s3://{bucket_name}/"), text))


def clip_and_track(image_id: Column) -> Column:
    """`<clip>_t<track>` split at the last `_t`."""
    return F.struct(F.regexp_extract(image_id, r"^(.*)_t(\d+)$", 1).alias("clip_id"), F.regexp_extract(image_id, r"^(.*)_t(\d+)$", 2).cast("long").alias("track_id"))
