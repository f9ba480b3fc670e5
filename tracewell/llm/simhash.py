"""SimHash near-dedup by pigeonhole blocks.

A fingerprint bit is 1 if it is set in over half the hashes of a text's word shingles. Fingerprints of 64 bits that differ in 3
bits at most agree in n - 3 or more of n blocks, so joining on each choice of n - 3 blocks finds them all; their distance is then verified. More
classes take more blocks, and so longer keys: 5 (10 tables, keys of 25 or 26 bits), 6 (20, 31 to 33) or 7 (35, 36 or 37).

Rows with one fingerprint are one class from the start, so exact copies make no pairs. A block's bucket emits links that connect its
close classes (at most one fewer than its members), never all pairs. A bucket over `HOT_BUCKET` classes is split
by four further blocks of the bits that its members do not share: of those at most 3 differ, so one of the four agrees. That is done up to three times; then
at most 16 bits are left.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.components import components
from tracewell.llm.store import hot_values, shuffle_partitions, spread_join, written
from tracewell.llm.text import Words, mixed, pieces, plain, spans

#: (classes, pigeonhole blocks for up to as many): a bucket then holds a few members on average.
BLOCKS = ((2**28, 5), (2**34, 6), (2**63, 7))
MAX_DISTANCE, SPLITS = 3, 3
HOT_BUCKET = 20_000
#: Buckets up to this size are compared pair by pair, larger ones by search from each newly found member.
SMALL_BUCKET = 6


def shingle_hashes(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(XXH64 of each shingle with seed 42, shingles of each text). Fewer words than width make one shingle of all."""
    n = np.diff(words.of)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    at = spans(words.of[:-1], count)
    to = np.minimum(at + width, np.repeat(words.of[1:], count))
    flat, digest = words.flat.tobytes(), xxhash.xxh64_intdigest
    return np.fromiter((digest(flat[a:b], 42) for a, b in zip(words.begin[at].tolist(), (words.begin[to] - 1).tolist())), np.uint64, len(at)), count


def majority_bits(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each text the 64-bit word whose bits are set in over half of its hashes (none: 0)."""
    some = np.flatnonzero(count)
    out = np.zeros(len(count), np.uint64)
    if len(some):
        starts = (np.cumsum(count) - count)[some]
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[some] = np.packbits(ones * 2 > count[some][:, None], axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def _fingerprints(width: int, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", 2 << 20):
            own = majority_bits(*shingle_hashes(Words(plain(piece, "text"), lower=True), width))
            yield pa.RecordBatch.from_arrays([piece.column(piece.schema.get_field_index(c)) for c in columns] + [pa.array(own.view(np.int64))], [*columns, "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint of each text as a signed long. A null text has no words: 0."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprints(width, ["doc_id"]), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _connect(own: np.ndarray, most: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that connect every pair of values at most `most` bits apart; each link reaches a value for the first time."""
    rest, a, b = own, [], []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            close = _distance(rest, at) <= most
            if close.any():
                found, rest = rest[close], rest[~close]
                a.append(np.full(len(found), at))
                b.append(found)
                queue.extend(found)
    return a, b


def _link(most: int):
    def found(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero(np.diff(key, prepend=key[0] ^ 1, append=key[-1] ^ 1))
        size = np.diff(edge)
        a, b = [], []
        in_small = np.repeat(size <= SMALL_BUCKET, size)
        for step in range(1, SMALL_BUCKET):
            at = np.flatnonzero(in_small[:-step] & (key[:-step] == key[step:]))
            at = at[_distance(fp[at], fp[at + step]) <= most]
            a.append(fp[at])
            b.append(fp[at + step])
        for i in np.flatnonzero(size > SMALL_BUCKET).tolist():
            more = _connect(fp[edge[i] : edge[i + 1]], most)
            a += more[0]
            b += more[1]
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if not len(key):
                continue
            cut = np.searchsorted(key, key[-1])  # the last bucket may go on in the next batch
            if held and cut:
                held.append((key[:cut], fp[:cut]))
                yield found(*map(np.concatenate, zip(*held)))
                held = []
            elif cut:
                yield found(key[:cut], fp[:cut])
            elif held and held[-1][0][-1] != key[0]:
                yield found(*map(np.concatenate, zip(*held)))
                held = []
            held.append((key[cut:], fp[cut:]))
        if held:
            yield found(*map(np.concatenate, zip(*held)))

    return run


def block_masks(classes: int) -> list[int]:
    """The bits of each choice of blocks on which two fingerprints at most MAX_DISTANCE bits apart may agree."""
    n = next(blocks for most, blocks in BLOCKS if classes <= most)
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [sum(1 << b for b in range(low, high)) for low, high in zip(edges, edges[1:])]
    return [sum(some) for some in combinations(blocks, n - MAX_DISTANCE)]


def _further(mask: int) -> list[int]:
    """The mask with each of four parts of the bits that it lacks."""
    rest = [b for b in range(64) if not mask >> b & 1]
    return [mask | sum(1 << b for b in rest[j::4]) for j in range(MAX_DISTANCE + 1)]


def _keyed(rows: DataFrame, masks: list[int]) -> DataFrame:
    """rows (fp, plan) with the key of the bits in masks[plan]."""
    signed = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in masks])
    return rows.withColumn("key", F.xxhash64("plan", F.col("fp").bitwiseAND(F.element_at(signed, F.col("plan") + 1))))


def close_links(classes: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """(a, b) over distinct fp values: links whose components are those of all pairs at most 3 bits apart."""
    partitions, masks = shuffle_partitions(classes.sparkSession), block_masks(classes.count())
    rows = _keyed(classes.select("fp", F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))).alias("plan")), masks)
    dealt = None
    for _ in range(SPLITS):
        hot = written(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot_bucket).select("key"), "hot")
        if hot.isEmpty():
            break
        cold = rows.join(hot, "key", "left_anti").select("fp", "key")
        dealt = cold if dealt is None else dealt.unionByName(cold)
        masks = [m for mask in masks for m in _further(mask)]
        split = rows.join(hot, "key", "left_semi").select("fp", F.explode(F.array(*[F.col("plan") * (MAX_DISTANCE + 1) + j for j in range(MAX_DISTANCE + 1)])).alias("plan"))
        rows = _keyed(split, masks)
    rows = rows.select("fp", "key")
    met = (rows if dealt is None else dealt.unionByName(rows)).select("key", "fp").repartition(partitions, "key").sortWithinPartitions("key", "fp")
    return met.mapInArrow(_link(MAX_DISTANCE), "a long, b long")


def simhash_components(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp and component_id: the least doc_id among the rows reachable by links of 3 or fewer differing bits.

    Null and empty texts have fingerprint 0 and link like any other. A null doc_id is passed over in the least, unless a
    component has no other. Repeated rows stay, each with its result. An empty table gives an empty table.
    """
    rows = written(fingerprints(docs, width), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
    roots = components(close_links(classes.select("fp")))
    grouped = classes.join(roots.hint("merge"), classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("classes"))
    named = spread_join(grouped.select("fp", "root"), least, "root", hot_values(least, "root", "classes"), "fp").select("fp", "component_id")
    # null ids would share a salt, so rows are told apart by their place in the written table
    placed = rows.withColumn("place", F.monotonically_increasing_id())
    return spread_join(placed, named, "fp", hot_values(classes, "fp", "n"), "place").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: F.Column) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
