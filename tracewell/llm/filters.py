"""Bit filters: a set of hashes in bounded memory, for tasks to look at before they send rows to an exact join or count."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a filter, at least and at most (8 KB to 16 MB). A set that is too large for the most makes it let more through, never less.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27


def bit_filter(hashes: DataFrame, column: str, n: int) -> np.ndarray:
    """The filter of about n hashes (a long column): words of 64 bits, made by Spark; what reaches the driver is the filter alone."""
    bits = min(max(LEAST_BITS, 1 << (16 * n).bit_length()), MOST_BITS)
    slot = F.shiftrightunsigned(column, 6).bitwiseAND(F.lit(bits // 64 - 1))
    one = F.expr(f"shiftleft(1L, cast(`{column}` & 63 as int))")
    found = hashes.select(slot.alias("slot"), one.alias("one")).groupBy("slot").agg(F.bit_or("one").alias("word")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[found.column(0).to_numpy()] = found.column(1).to_numpy().view(np.uint64)
    return words


def may_hold(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the set (False is certain)."""
    hashes = hashes.view(np.uint64)
    return (words[(hashes >> np.uint64(6)) & np.uint64(len(words) - 1)] >> (hashes & np.uint64(63))) & np.uint64(1) > 0
