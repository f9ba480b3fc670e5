"""Phrase collocations by Apriori passes over levels.

Level k holds the phrases of k words that occur often enough in their group, with exact counts. A pass over the texts emits a k-gram only if both of its
(k-1)-grams may be frequent: the level below is broadcast as a bit filter of bounded size, which lets a few others through; the count drops those. Then each
candidate's cuts are scored from the level tables.

A task counts the phrases of a piece of texts before they are shuffled, and Spark combines counts before its exchange, so copies and common phrases cost little.
Words that begin or end very many candidates are dealt over many tasks when counts are looked up.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.filters import bit_filter, may_hold
from tracewell.llm.store import hot_values, spread_join, written
from tracewell.llm.text import Words, byte_table, mixed, pieces, plain, run_hash

#: What ends a piece, and what stands between words as well (fixed values).
BREAKS = (*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D)
BLANKS = (0x20, 0x09)
#: Parts of a group that are ranked before the group is.
RANK_PARTS = 64


def _grams(h: np.ndarray, group: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words from each on, within its group."""
    return mixed(run_hash(h, k) ^ group, k)


def _counted(k: int, below: np.ndarray | None):
    """(group, phrase, n, h) of a piece's k-grams; below: the filter of the frequent (k-1)-grams. A row of null phrase holds a group's count of words (k = 1)."""
    breaks = byte_table(BREAKS)
    apart = breaks | byte_table(BLANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", 2 << 20):
            words = Words(plain(piece, "text"), lower=True, separators=apart, breaks=breaks)
            if not len(words):
                continue
            coded = piece.column(0).dictionary_encode()
            names = coded.dictionary.to_pylist()
            group = np.repeat(coded.indices.to_numpy(zero_copy_only=False), np.diff(words.of)).astype(np.int64)
            seed = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in names], np.uint64)[group]
            h = words.hashes()
            n, whole = len(words), np.ones(len(words), bool)
            whole[max(n - k + 1, 0) :] = False
            for j in range(1, min(k, n)):
                whole[: n - j] &= ~words.broken[j:]
            if below is not None:
                often = may_hold(below, _grams(h, seed, k - 1))
                whole[:-1] &= often[:-1] & often[1:]
            at = np.flatnonzero(whole)
            # exact numbers of the grams: (((group, first word), second), ...)
            number = group[at]
            for j in range(k):
                number = number * len(words.unique) + words.codes[at + j]
                if j < k - 1:
                    number = np.unique(number, return_inverse=True)[1]
            _, first, count = np.unique(number, return_index=True, return_counts=True)
            first = at[first]
            out = [group[first], words.runs(first, k), count, _grams(h, seed, k)[first].view(np.int64)]
            if k == 1:
                used, sums = np.unique(group, return_counts=True)
                out = [np.concatenate([out[0], used]), pa.concat_arrays([out[1], pa.nulls(len(used), pa.string())]), np.concatenate([count, sums]), np.concatenate([out[3], np.zeros(len(used), np.int64)])]
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(out[0])), out[1], pa.array(out[2]), pa.array(out[3])], ["group", "phrase", "n", "h"])

    return run


def level(docs: DataFrame, k: int, least: int, below: np.ndarray | None) -> DataFrame:
    found = docs.mapInArrow(_counted(k, below), "group string, phrase string, n long, h long").groupBy("group", "phrase").agg(F.sum("n").alias("n"), F.first("h").alias("h"))
    return written(found.where((F.col("n") >= least) | F.col("phrase").isNull()), f"level-{k}")


def _key(phrase: Column) -> Column:
    """Group and phrase as one text."""
    return F.concat(F.length("group").cast("string"), F.lit(":"), "group", phrase)


def _hot(rows: DataFrame, key: str) -> list:
    return hot_values(rows.groupBy(key).agg(F.count("*").alias("n")), key, "n")


def _part(words: str, first: int, count: int) -> Column:
    return F.array_join(F.slice(words, first + 1, count), " ")


def collocations(docs: DataFrame, group: str = "lang", most_words: int = 3, least: int = 10, covered: int = 50, first: int = 2000) -> DataFrame:
    """The `first` best phrases of 2 to most_words words of each group: group (under its own name), rank (from 1), phrase, words, cut, a, l, r, n, score.

    A-Z is lower-cased, texts are split into pieces at [.,;:!?\\x0A-\\x0D] and pieces into words [^\\x20\\x09]+. Within a group n counts all words and a the occurrences
    of a phrase, overlaps included; phrases of a >= least are candidates. A cut after k words scores floor(1000000 a a / (l r)), l and r being the counts of both
    parts; the lowest-scoring cut counts, then the smallest k. A candidate goes if a longer one, dropped or not, holds its words one after another and 100 f(longer)
    >= covered * a. Ranked by score and a, highest first, then by the phrase's bytes, so ranks are never tied. Products have up to 38 digits, that is counts up to
    10^15.

    docs has text and the group's column, cast to text; null counts as the group "und" (together with rows of that name) and a null text as empty.
    Repeated rows count as often as they occur. Other columns are not looked at. Without a frequent phrase, as without documents, there are no rows.
    """
    own = docs.select(F.coalesce(F.col(f"`{group}`").cast("string"), F.lit("und")).alias("group"), F.col("text"))
    levels = [level(own, 1, least, None)]
    totals = levels[0].where("phrase is null").select("group", F.col("n").alias("total"))
    levels[0] = levels[0].where("phrase is not null")
    for k in range(2, most_words + 1):
        levels.append(level(own, k, least, bit_filter(levels[-1], "h", levels[-1].count())))

    split = F.split("phrase", " ").alias("words")
    candidates = [x.select("group", "phrase", F.col("n").alias("a"), split) for x in levels[1:]]
    cuts = [
        x.select("group", "phrase", "a", F.lit(j).alias("cut"), _key(_part("words", 0, j)).alias("left"), _key(_part("words", j, k - j)).alias("right"))
        for k, x in enumerate(candidates, 2)
        for j in range(1, k)
    ]
    cuts = reduce(DataFrame.unionAll, cuts)
    counts = reduce(DataFrame.unionAll, [x.select(_key(F.col("phrase")).alias("key"), F.col("n").alias("f")) for x in levels[: most_words - 1]])
    known = spread_join(cuts, counts.toDF("left", "l"), "left", _hot(cuts, "left"), "phrase")
    known = spread_join(known, counts.toDF("right", "r"), "right", _hot(cuts, "right"), "phrase")
    d = lambda c: F.col(c).cast("decimal(15,0)")
    known = known.withColumn("top", d("a") * d("a") * F.lit(1_000_000).cast("decimal(7,0)")).withColumn("low", d("l") * d("r"))
    best = F.min(F.struct(F.expr("top div low").alias("score"), "cut", "l", "r")).alias("best")
    scored = known.groupBy("group", "phrase").agg(F.first("a").alias("a"), best)

    parts = [
        x.select("group", _part("words", i, m).alias("phrase"), F.col("a").alias("longer"))
        for k, x in enumerate(candidates, 2)
        for m in range(2, k)
        for i in range(k - m + 1)
    ]
    if parts:
        within = reduce(DataFrame.unionAll, parts).groupBy("group", "phrase").agg(F.max("longer").alias("longer"))
        scored = scored.join(within.hint("merge"), ["group", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * covered))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = scored.select("group", "phrase", "a", "best.*", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)).alias("part"))
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    ranked = rows.withColumn("rank", rank("group", "part")).where(F.col("rank") <= first).withColumn("rank", rank("group").cast("long")).where(F.col("rank") <= first)
    return ranked.join(totals, "group").select(F.col("group").alias(group), "rank", "phrase", F.size(F.split("phrase", " ")).alias("words"), "cut", "a", "l", "r", F.col("total").alias("n"), "score")
