"""Ranked lexical search with block-max pruning.

The index is a table of blocks, each a range of documents as they are stored: its dictionary with the documents that hold each term and the term's largest
impact there (its maxima), and the forward index, impacts by document. Impacts are final in the index, since document and term counts are taken before it is written.

Queries come in batches of bounded size, which are small enough to travel with the code of the tasks. For a batch:

1. document frequencies are summed over the blocks' dictionaries and give the weights;
2. a query's bound for a block is the sum of weight times maximum; quantiles of the bounds cut each query's order of blocks, best first, into bands;
3. band by band, tasks score those blocks whose bound reaches the query's k-th best score so far (in all bands done, and in the task), and keep the
   k best of a query. Blocks under it hold no result, ties included. The forward index of a block that no query wants is not opened.

No exchange carries the index: blocks are judged where they are read, and a task hands on k rows a query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.store import new_path, written
from tracewell.llm.text import NO_TERM, Words, bytes_of, pieces, plain

#: Documents and bytes of text of a block, at most (a longer text is a block by itself).
BLOCK_DOCUMENTS, BLOCK_BYTES = 128, 256 << 10
#: Terms times queries of a batch, at most (one query may have more).
BATCH = 1 << 22
#: Share of a query's blocks that have been looked at after each band.
BANDS = (1 / 256, 1 / 16, 1.0)
#: Rows that a task holds before it reduces them to the best.
HELD = 1 << 18
#: Impacts are below this.
IMPACT = 1_000_000

_BLOCK = "summary binary, forward binary"
_BEST = "query int, score long, doc_id long"
_ZSTD = 3


def _terms(batch: pa.RecordBatch) -> Words:
    return Words(plain(batch, "text"), lower=True, separators=NO_TERM)


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, "text"):
        n = np.diff(_terms(piece).of)
        yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], ["documents", "terms"])


def _packed(*arrays: np.ndarray | bytes) -> bytes:
    sizes = np.array([len(a) for a in arrays], np.int64)
    return zstandard.ZstdCompressor(level=_ZSTD).compress(sizes.tobytes() + b"".join(a if isinstance(a, bytes) else a.tobytes() for a in arrays))


def _unpacked(blob: bytes, *kinds: type) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes, at, out = np.frombuffer(raw, np.int64, len(kinds)), 8 * len(kinds), []
    for kind, size in zip(kinds, sizes.tolist()):
        out.append(np.frombuffer(raw, kind, size, at))
        at += size * np.dtype(kind).itemsize
    return out


def _block(piece: pa.RecordBatch, documents: int, terms: int) -> tuple[bytes, bytes] | None:
    words = _terms(piece)
    if not len(words):
        return None
    n = np.diff(words.of)
    size = len(words.unique)
    of = np.repeat(np.arange(len(n)), n)
    posting, tf = np.unique(of * size + words.codes, return_counts=True)
    doc, term = posting // size, posting % size
    m = 10 + (90 * n[doc] * documents) // terms
    impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m)
    df, most = np.bincount(term, minlength=size), np.zeros(size, np.int64)
    np.maximum.at(most, term, impact)
    text, begin = bytes_of(words.unique)
    summary = _packed(text, begin.astype(np.int32), df.astype(np.int32), most.astype(np.int32))
    ids = piece.column(piece.schema.get_field_index("doc_id"))
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    forward = _packed(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), known, doc.astype(np.int32), term.astype(np.int32), impact.astype(np.int32))
    return summary, forward


@dataclass
class Index:
    """blocks: a written table; documents that hold a term, and terms with their repeats, in all of them."""

    blocks: DataFrame
    documents: int
    terms: int


def build_index(docs: DataFrame, documents_of_block: int = BLOCK_DOCUMENTS, bytes_of_block: int = BLOCK_BYTES) -> Index:
    """docs has doc_id (a whole number) and text; other columns are not looked at. A null or empty text, or one without a term, is in no block."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    totals = own.select("text").mapInArrow(_lengths, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    documents, terms = totals[0] or 0, totals[1] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", bytes_of_block, documents_of_block):
            found = _block(piece, documents, terms)
            if found is not None:
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in found], ["summary", "forward"])

    return Index(written(own.mapInArrow(run, _BLOCK), "blocks", "uncompressed"), documents, terms)


@dataclass
class Batch:
    """rows: the queries' numbers; terms: all their terms; each query's terms by number."""

    rows: list[int] = field(default_factory=list)
    terms: dict[str, int] = field(default_factory=dict)
    queries: list[np.ndarray] = field(default_factory=list)

    def add(self, row: int, terms: list[str]) -> None:
        self.rows.append(row)
        self.queries.append(np.array([self.terms.setdefault(t, len(self.terms)) for t in terms], np.int64))

    def weights(self, df: np.ndarray, documents: int) -> np.ndarray:
        """Terms by queries. Doubles where every score is a whole number under 2^53, longs otherwise."""
        w = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        out = np.zeros((len(w), len(self.queries)), np.int64)
        for i, q in enumerate(self.queries):
            out[q, i] = w[q]
        return out.astype(float) if (out.sum(0) < 2**53 // IMPACT).all() else out


def _distinct_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, "text"):
        words = _terms(piece)
        names = [x[:-1].decode() for x in words.unique.to_pylist()] if len(words) else []
        found = [[names[c] for c in np.unique(words.codes[a:b])] if b > a else [] for a, b in zip(words.of[:-1], words.of[1:])]
        yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(found, pa.list_(pa.string()))], ["query_row", "terms"])


def _batches(queries: DataFrame) -> Iterator[Batch]:
    batch = Batch()
    for row in queries.select("query_row", "terms").where(F.size("terms") > 0).toLocalIterator():  # the driver holds one partition of them at a time
        new = sum(t not in batch.terms for t in row["terms"])
        if batch.rows and (len(batch.terms) + new) * (len(batch.rows) + 1) > BATCH:
            yield batch
            batch = Batch()
        batch.add(row["query_row"], row["terms"])
    if batch.rows:
        yield batch


class _Found:
    """The terms of a batch in a block's dictionary: at (their places there) and which."""

    def __init__(self, summary: bytes, terms: pa.Array):
        text, begin, self.df, self.most = _unpacked(summary, np.uint8, np.int32, np.int32, np.int32)
        # every term is followed by a space
        own = pa.Array.from_buffers(pa.binary(), len(self.df), [None, pa.py_buffer(begin), pa.py_buffer(text)])
        which = pc.index_in(own, value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.at = np.flatnonzero(which >= 0)
        self.which = which[self.at]


def _values(terms: list[str]) -> pa.Array:
    return pa.array([f"{t} ".encode() for t in terms], pa.binary())


def _frequencies(terms: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, df = _values(terms), np.zeros(len(terms), np.int64)
        for batch in batches:
            for summary in batch.column(0):
                found = _Found(summary.as_py(), values)
                df[found.which] += found.df[found.at]
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(df)), pa.array(df[df > 0])], ["term", "df"])

    return run


def _bounds(terms: list[str], weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = _values(terms)
        for batch in batches:
            for summary in batch.column(0):
                found = _Found(summary.as_py(), values)
                bound = found.most[found.at].astype(weights.dtype) @ weights[found.which]
                some = np.flatnonzero(bound)
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(bound[some].astype(np.int64))], ["query", "bound"])

    return run


def _best(rows: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """The k best rows of each query: (query, score, known, id), by query."""
    query, score, known, ids = (np.concatenate(x) for x in zip(*rows))
    order = np.lexsort((ids, ~known, -score, query))
    query = query[order]
    kept = order[np.arange(len(order)) - np.searchsorted(query, query) < k]
    return tuple(x[kept] for x in (np.concatenate([r[0] for r in rows]), score, known, ids))


def _scored(terms: list[str], weights: np.ndarray, low: np.ndarray, high: np.ndarray, reached: np.ndarray, k: int):
    """Blocks whose bound is in [low, high) and no less than the score reached."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, least, held, n = _values(terms), reached.copy(), [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                found = _Found(batch.column(0)[i].as_py(), values)
                bound = found.most[found.at].astype(weights.dtype) @ weights[found.which]
                wanted = np.flatnonzero((bound > 0) & (bound >= low) & (bound < high) & (bound >= least))
                if not len(wanted):
                    continue
                ids, known, doc, term, impact = _unpacked(batch.column(1)[i].as_py(), np.int64, bool, np.int32, np.int32, np.int32)
                place = np.full(len(found.df), -1)
                place[found.at] = np.arange(len(found.at))
                own = place[term] >= 0
                impacts = np.zeros((len(ids), len(found.at)), weights.dtype)
                impacts[doc[own], place[term[own]]] = impact[own]
                scores = (impacts @ weights[np.ix_(found.which, wanted)]).astype(np.int64)
                d, q = np.nonzero((scores > 0) & (scores >= least[wanted]))
                held.append((wanted[q], scores[d, q], known[d], ids[d]))
                n += len(d)
                if n > HELD:
                    held = [_best(held, k)]
                    n = len(held[0][0])
                    full = np.flatnonzero(np.bincount(held[0][0], minlength=len(least)) >= k)
                    last = np.searchsorted(held[0][0], full, "right") - 1
                    least[full] = np.maximum(least[full], held[0][1][last])
        if held:
            query, score, known, ids = _best(held, k)
            yield pa.RecordBatch.from_arrays([pa.array(query.astype(np.int32)), pa.array(score), pa.array(ids, mask=~known)], ["query", "score", "doc_id"])

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _answers(index: Index, batch: Batch, k: int) -> DataFrame:
    terms, n = list(batch.terms), len(batch.rows)
    df = np.zeros(len(terms), np.int64)
    for r in index.blocks.select("summary").mapInArrow(_frequencies(terms), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r["term"]] = r["df"]
    weights = batch.weights(df, index.documents)
    cuts = F.percentile_approx("bound", [1 - b for b in BANDS[:-1]], 2000).alias("cuts")
    low = np.zeros((len(BANDS), n), np.int64)
    for r in index.blocks.select("summary").mapInArrow(_bounds(terms, weights), "query int, bound long").groupBy("query").agg(cuts).collect():
        low[:-1, r["query"]] = r["cuts"]
    high, reached, found = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64), None
    for band in low:
        own = written(index.blocks.mapInArrow(_scored(terms, weights, band, high, reached, k), _BEST), "band")
        found = own if found is None else found.unionAll(own)
        high = np.minimum(high, band)
        for r in _ranked(found, k).where(F.col("rank") == k).select("query", "score").collect():
            reached[r["query"]] = r["score"]
    rows = F.element_at(F.lit(batch.rows), F.col("query") + 1).cast("long")
    return _ranked(found, k).select(rows.alias("query_row"), "rank", "doc_id", "score")


def search(index: Index, items: DataFrame, k: int = 10) -> DataFrame:
    """The k documents of the highest scores above 0 for each row of items (item_id and text): item_id, rank (from 1), doc_id, score.

    A term is a maximal match of [^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+ with A-Z lower-cased; a score is the sum over a query's different terms of
    floor(1000 ln((2N+2) / (2df+1))) * (1000000000 tf div (1000 tf + 8 m)), m = 10 + (90 n N div L). Equal scores go by ascending doc_id, null last; documents of one doc_id
    are ranked each. An item without terms, or whose terms no document holds, has no rows; repeated items are answered each. Without documents there are no rows.
    """
    spark = items.sparkSession
    own = items.select(F.monotonically_increasing_id().alias("query_row"), F.col("item_id"), "text")
    own = written(own, "queries")
    queries = own.select("query_row", "text").mapInArrow(_distinct_terms, "query_row long, terms array<string>")
    path, schema = new_path(spark, "answers"), "query_row long, rank int, doc_id long, score long"
    spark.createDataFrame([], schema).write.parquet(path)
    if index.documents:
        for batch in _batches(queries):
            _answers(index, batch, k).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path).join(own.select("query_row", "item_id").hint("merge"), "query_row").select("item_id", "rank", "doc_id", "score")
