"""Groups of near copies at a Jaccard similarity of word shingles: SimHash blocks first, exact prefixes of shingle sets for what those cannot promise.

1. Texts of equal 128-bit hashes are one class. Each class has its SimHash fingerprint of operator 10; classes of one fingerprint, and of fingerprints that its pigeonhole blocks
   link (3 bits at most), are candidates. Near copies of 0.8 differ in up to 16 bits, so these are only the closest.
2. In one order of all shingles, two sets of the given similarity share a shingle within their first n - ceil(similarity * n) + 1. Classes meet on each of
   those, so no pair of the given similarity is missed, whatever its edits and however many documents there are. Shingles that a sample shows to be common
   come last in the order; that saves work and decides nothing.
3. The members of a bucket of up to SMALL are compared at once. A larger one of up to WHOLE is first parted: two members stay together only if a chain of pairs that sizes, places
   and sketches (below) let through joins them, and a member without any such pair goes. What those rule out is no link, so nothing is lost; buckets of a common shingle mostly vanish.
   In a part, or a bucket over WHOLE, the first member is compared with all others, then the next 8, 64 and so on,
   each with all behind it, until all members are in one component or every pair has been compared. Pairs of one component are passed over. Large groups of
   close classes are thus done in a round or two; when few comparisons are left in all buckets, the next round makes them all.
   A bucket over CHUNK members is dealt in chunks, and the members whose turn it is are sent to each of them, so no task holds a hot bucket.
   Members carry sketches of their sets there. Two sketches differ in no more bits than their sets do in shingles, so a pair whose sketches differ in more than
   `similarity` allows is none and goes no further. Nearly all pairs that leave a large bucket are links, and those of one component are passed over: a group's pairs grow with its members, not their square.
4. Pairs are compared by their whole shingle sets, built anew from the two texts.
5. Components of the links are the groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.components import components, least_reachable
from tracewell.llm.simhash import close_links, majority_bits, shingle_hashes
from tracewell.llm.store import discard, give_back, hot_values, partitions_for, shuffle_partitions, shuffles_for, spread_join, written
from tracewell.llm.text import Words, mixed, pieces, plain, run_hash, spans, squeezed, unsqueezed

#: Shingles are ordered by a sample of about so many texts; those in COMMON of them are common, the first COMMON_MOST count.
SAMPLE, COMMON, COMMON_MOST = 10_000, 3, 100_000
#: A bucket of so many members is compared pair by pair; one of up to WHOLE is parted by a task, so a row costs WHOLE comparisons of sketches at most;
#: CHUNK members of a larger one are held by a task at a time.
SMALL, WHOLE, CHUNK = 8, 2048, 50_000
#: The ends of up to so many pairs (two longs each) are broadcast to find their texts; those of more are joined by a shuffle.
FEW_PAIRS = 100_000
#: Once no more comparisons than this are left in all buckets together, they are all made in one round.
FEW_COMPARISONS = 20_000
#: Bits of a sketch. They tell sets apart well up to about as many shingles; beyond twice that they rule out few pairs, and none that is a link.
#: Sets of over LONG shingles have a second sketch of LONG_SKETCH bits.
SKETCH, LONG, LONG_SKETCH = 1024, 1500, 8192
#: Words of a fingerprint's shingles.
FINGERPRINT_WORDS = 3
_EPS = 1e-9
_ALL = 1 << 60


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of each text, ascending within it; where each text's begin, one more at the end).

    A text of fewer words than a shingle is one shingle.
    """
    words = Words(texts, lower=True)
    n = np.diff(words.of)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(n)), count)
    shingles = mixed(run_hash(words.hashes(), width), 22)[spans(words.of[:-1], count)]
    flat, first = words.flat.tobytes(), np.cumsum(count) - count
    for i in np.flatnonzero((n > 0) & (n < width)).tolist():
        shingles[first[i]] = int.from_bytes(hashlib.sha256(flat[words.begin[words.of[i]] : words.begin[words.of[i + 1]]]).digest()[:8], "little")
    order = np.lexsort((shingles, doc))
    doc, shingles = doc[order], shingles[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (shingles[1:] != shingles[:-1])
    doc, shingles = doc[new], shingles[new]
    return shingles, np.searchsorted(doc, np.arange(len(n) + 1))


def sketches(shingles: np.ndarray, cuts: np.ndarray, bits: int = SKETCH) -> np.ndarray:
    """`bits` bits of each set (a row of words): whether an odd number of its shingles has that place. Each shingle in one set only changes one bit."""
    place = mixed(shingles, 41) % np.uint64(bits)
    out = np.zeros((len(cuts) - 1, bits // 64), np.uint64)
    row = np.repeat(np.arange(len(out)), np.diff(cuts))
    np.bitwise_xor.at(out, (row, (place // np.uint64(64)).astype(np.int64)), np.uint64(1) << place % np.uint64(64))
    return out


def _texts(blobs: list[bytes]) -> pa.Array:
    opened = zstandard.ZstdDecompressor()
    return pa.array([opened.decompress(x).decode() for x in blobs], pa.large_string())


def _all_shingles(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "blob", 1 << 19):
            yield pa.RecordBatch.from_arrays([pa.array(shingle_sets(_texts(piece.column(1).to_pylist()), width)[0].view(np.int64))], ["key"])

    return run


def _prefixes(width: int, similarity: float, common: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "blob", 1 << 19):
            shingles, cuts = shingle_sets(_texts(piece.column(1).to_pylist()), width)
            n = np.diff(cuts)
            late = np.zeros(len(shingles), np.int64)
            if len(common):
                late[common[np.minimum(np.searchsorted(common, shingles), len(common) - 1)] == shingles] = 1
            order = np.argsort(np.repeat(np.arange(len(n)), n) * 2 + late, kind="stable")
            held = np.where(n > 0, n - np.ceil(similarity * n - _EPS).astype(np.int64) + 1, 0)
            at = spans(cuts[:-1], held)
            row = np.repeat(np.arange(len(n)), held)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(shingles[order[at]].view(np.int64)),
                    piece.column(0).take(pa.array(row)),
                    pa.array(n[row].astype(np.int32)),
                    pa.array((at - cuts[:-1][row]).astype(np.int32)),
                ],
                ["key", "copy", "n", "pos"],
            )

    return run


def _sketched(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "blob", 1 << 19):
            shingles, cuts = shingle_sets(_texts(piece.column(1).to_pylist()), width)
            own = sketches(shingles, cuts)
            more = [sketches(shingles[a:b], np.array([0, b - a]), LONG_SKETCH).tobytes() if b - a > LONG else None for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([x.tobytes() for x in own], pa.binary()), pa.array(more, pa.binary())], ["copy", "bits", "more"])

    return run


def _numbers(column: pa.Array, name: str) -> np.ndarray:
    """A column of numbers, or the rows of one of sketches; those of long sets as they are."""
    if name == "more":
        return np.array([*column.to_pylist(), None], object)[:-1]
    if not (pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)):
        return column.to_numpy()
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), SKETCH // 64)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by the first, cut so that no value of it is divided."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [_numbers(c, name) for c, name in zip(batch.columns, batch.schema.names)]
        cut = int(np.searchsorted(now[0], now[0][-1]))  # the last bucket may go on in the next batch
        if cut:
            held.append([c[:cut] for c in now])
        if held and (cut or held[-1][0][-1] != now[0][0]):
            yield [np.concatenate(c) for c in zip(*held)]
            held = []
        held.append([c[cut:] for c in now])
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def _ranks(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each row's bucket begins, how many rows it has)."""
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    size = np.diff(edge)
    return np.repeat(edge[:-1], size), np.repeat(size, size)


def _similar(x: np.ndarray, y: np.ndarray, n: np.ndarray, pos: np.ndarray, similarity: float) -> np.ndarray:
    """Which of the row pairs (x, y) of one bucket may have `similarity`, by the sizes of their sets and their places in them."""
    n, left = n.astype(np.int64), (n - pos).astype(np.int64)
    # the rarest shingle that both hold is met in some bucket, and there nothing before it is shared
    enough = np.minimum(left[x], left[y]) >= similarity / (1 + similarity) * (n[x] + n[y]) - _EPS
    return enough & (np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y]) - _EPS)


def _near(x: np.ndarray, y: np.ndarray, n: np.ndarray, bits: np.ndarray, more: np.ndarray, similarity: float) -> np.ndarray:
    """Which of the row pairs (x, y) may have `similarity`, by their sketches."""
    # sets of this similarity differ in (1 - similarity) / (1 + similarity) of their shingles at most
    most = (1 - similarity) / (1 + similarity) * (n[x].astype(np.int64) + n[y]) + 1e-6
    good = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64) <= most
    both = np.flatnonzero(good & (n[x] > LONG) & (n[y] > LONG))
    for at in range(0, len(both), 4096):
        own = both[at : at + 4096]
        p, q = (np.frombuffer(b"".join(more[z[own]]), np.uint64).reshape(len(own), -1) for z in (x, y))
        good[own] = np.bitwise_count(p ^ q).sum(axis=1, dtype=np.int64) <= most[own]
    return good


def _parts(key: np.ndarray, n: np.ndarray, pos: np.ndarray, similarity: float, near=None) -> np.ndarray:
    """For each row, sorted by bucket, the first row of its bucket to which a chain of pairs that may be similar leads."""
    if not len(key):
        return np.zeros(0, np.int64)
    start, size = _ranks(key)
    rest = every = np.arange(len(key))
    place, part = every - start, every
    for r in range(int(size.max()) - 1):
        rest = rest[place[rest] > r]
        x, y = rest, start[rest] + r
        for good in (lambda: part[x] != part[y], lambda: _similar(x, y, n, pos, similarity), *([lambda: near(x, y)] if near else [])):
            some = good()
            x, y = x[some], y[some]
        if len(x):
            node, root = least_reachable(part[x], part[y])
            to = every.copy()
            to[node] = root
            part = to[part]
    return part


def _shared(similarity: float, most: int):
    """The pairs of small buckets (copy, other; key null) and the rows of larger ones with their ranks (other null); rows come sorted by bucket.

    whole: the row's bucket has no more than `most` members. Those that can be similar to none of the others are left out.
    """
    names = ["key", "copy", "other", "n", "pos", "rank", "whole"]

    def pairs(key: np.ndarray, copy: np.ndarray, n: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
        found = [np.zeros((0, 2), np.int64)]
        for step in range(1, min(SMALL, len(key))):
            x = np.flatnonzero(key[step:] == key[:-step])
            x = x[_similar(x, x + step, n, pos, similarity)]
            found.append(np.stack([np.minimum(copy[x], copy[x + step]), np.maximum(copy[x], copy[x + step])], 1))
        both = np.unique(np.concatenate(found), axis=0)
        none = [pa.nulls(len(both), t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_())]
        return pa.RecordBatch.from_arrays([none[0], pa.array(both[:, 0]), pa.array(both[:, 1]), *none[1:]], names)

    def out(now: list[np.ndarray], rank: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        part = np.flatnonzero((size > SMALL) & (size <= most))
        first = _parts(*(now[i][part] for i in (0, 2, 3)), similarity)
        some = np.sort(np.concatenate([np.flatnonzero(size > most), part[np.bincount(first, minlength=1)[first] > 1]]))
        if len(some):
            own = [pa.array(c[some]) for c in now]
            yield pa.RecordBatch.from_arrays([*own[:2], pa.nulls(len(some), pa.int64()), *own[2:], pa.array(rank[some]), pa.array(size[some] <= most)], names)
        some = np.flatnonzero((size <= SMALL) & (size > 1))
        if len(some):
            yield pairs(*(c[some] for c in now))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, gone, held = None, 0, []  # the bucket that may go on: its rows that are out already, or its rows
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [c.to_numpy() for c in batch.columns]
            if held:
                now, held = [np.concatenate(c) for c in zip(held, now)], []
            start, size = _ranks(now[0])
            rank = np.arange(len(start)) - start
            if gone and now[0][0] == key:
                first = slice(0, int(size[0]))
                rank[first] += gone
                size[first] += gone
            key, gone = now[0][-1], int(size[-1]) if size[-1] > most else 0
            end = len(start) if gone else int(start[-1])
            if not gone:
                held = [c[end:] for c in now]
            yield from out([c[:end] for c in now], rank[:end], size[:end])
        if held:
            start, size = _ranks(held[0])
            yield from out(held, np.arange(len(start)) - start, size)

    return run


def _parted(similarity: float):
    """Rows of whole buckets, sorted by bucket, in parts that no pair which may be similar leaves; members without such a pair go. A part's key is a hash of its members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, copy, n, pos, bits, more in _buckets(batches):
            part = _parts(key, n, pos, similarity, lambda x, y: _near(x, y, n, bits, more, similarity))
            own = np.argsort(part, kind="stable")
            own = own[np.bincount(part, minlength=len(part))[part[own]] > 1]
            part = part[own]
            if not len(own):
                continue
            start, size = _ranks(part)
            rank = np.arange(len(own)) - start
            parts = np.repeat(np.add.reduceat(mixed(copy[own].view(np.uint64), 42), np.flatnonzero(rank == 0)), size[rank == 0]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (parts, copy[own], n[own], pos[own], rank)], ["key", "copy", "n", "pos", "rank"])

    return run


def _pairs(high: int, similarity: float):
    """Members of ranks below high, which come first, with all behind them that are not in their component and may be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, chunk, rank, copy, root, n, pos, bits, more in _buckets(batches):
            edge = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1]), [True])))
            size = np.diff(edge)
            start = np.repeat(edge[:-1], size)
            place, turns = np.arange(len(key)) - start, np.repeat(np.add.reduceat((rank < high).astype(np.int64), edge[:-1]), size)
            found = [np.zeros((0, 2), np.int64)]
            rest = np.arange(len(key))
            for r in range(int(turns.max())):
                rest = rest[(place[rest] > r) & (turns[rest] > r)]
                with_ = start[rest] + r
                good = (root[rest] != root[with_]) & _similar(rest, with_, n, pos, similarity)
                x, y = rest[good], with_[good]
                good = _near(x, y, n, bits, more, similarity)
                x, y = copy[x[good]], copy[y[good]]
                found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], 1))
                if len(found) > 64:
                    found = [np.unique(np.concatenate(found), axis=0)]
            both = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    return run


def _dealt(alive: DataFrame, bits: DataFrame, low: int, high: int, partitions: int) -> DataFrame:
    """Rows of one chunk of a bucket with their sketches, the members whose turn it is first; those are in every chunk."""
    columns = ["key", "chunk", "rank", "copy", "root", "n", "pos"]
    large = alive.where(F.col("rank") >= CHUNK).groupBy("key").agg(F.max("rank").alias("last"))
    turn = alive.where((F.col("rank") >= low) & (F.col("rank") < high))
    if large.isEmpty():
        turn = turn.withColumn("chunk", F.lit(0))
    else:
        turn = turn.join(large, "key", "left").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor(F.coalesce("last", F.lit(0)) / CHUNK).cast("int"))))
    rest = alive.where(F.col("rank") >= high).withColumn("chunk", F.floor(F.col("rank") / CHUNK).cast("int"))
    both = turn.select(columns).unionByName(rest.select(columns)).join(bits.hint("merge"), "copy").select(*columns, "bits", "more")
    return both.repartition(partitions, "key", "chunk").sortWithinPartitions("key", "chunk", "rank")


def _verified(width: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "right", 1 << 19):
            own = dict(zip(piece.column(0).to_pylist(), piece.column(2).to_pylist())) | dict(zip(piece.column(1).to_pylist(), piece.column(3).to_pylist()))
            at = {x: i for i, x in enumerate(own)}
            shingles, cuts = shingle_sets(_texts(list(own.values())), width)
            good = []
            for x, y in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                p, q = shingles[cuts[at[x]] : cuts[at[x] + 1]], shingles[cuts[at[y]] : cuts[at[y] + 1]]
                both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum()) if len(q) else 0
                good.append(both >= similarity * (len(p) + len(q) - both) - _EPS)
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([piece.column(0).filter(keep), piece.column(1).filter(keep)], ["a", "b"])

    return run


def _common(texts: DataFrame, width: int) -> np.ndarray:
    """Shingles that many texts of a sample hold, ascending. They only set the order of shingles."""
    part = max(1, texts.count() // SAMPLE)
    counted = texts.where(F.pmod(F.xxhash64("copy"), F.lit(part)) == 0).select("copy", "blob").mapInArrow(_all_shingles(width), "key long").groupBy("key").agg(F.count("*").alias("n"))
    rows = counted.where(F.col("n") >= COMMON).orderBy(F.desc("n"), "key").limit(COMMON_MOST).toArrow()
    return np.sort(rows.column("key").to_numpy().view(np.uint64))


def _sketches(texts: DataFrame, alive: DataFrame, width: int) -> DataFrame:
    """(copy, bits, more): the sketches of each text in `alive`."""
    own = written(alive.select("copy").distinct(), "large")
    few = F.broadcast(own) if own.count() <= 2 * FEW_PAIRS else own.hint("merge")
    bits = written(texts.select("copy", "blob").join(few, "copy", "left_semi").mapInArrow(_sketched(width), "copy long, bits binary, more binary"), "sketches")
    discard(own)
    return bits


def _links(texts: DataFrame, pairs: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of `similarity` or more."""
    n = pairs.count()
    with shuffles_for(texts.sparkSession, n, 20_000):
        ends = pairs.select(F.explode(F.array("a", "b")).alias("copy")).groupBy("copy").agg(F.count("*").alias("n"))
        hot = hot_values(ends, "copy", "n", 2 * n)
        ends = ends.select("copy")
        own = texts.select("copy", "blob").join(F.broadcast(ends) if n <= FEW_PAIRS else ends.hint("merge"), "copy", "left_semi")
        # the first of a large group is in as many pairs as it has members
        both = spread_join(spread_join(pairs, own.toDF("a", "left"), "a", hot, "b"), own.toDF("b", "right"), "b", hot, "a").select("a", "b", "left", "right")
        return written(both.mapInArrow(_verified(width, similarity), "a long, b long"), "links")


def fingerprint_pairs(texts: DataFrame) -> DataFrame:
    """(a, b), a < b: texts of one fingerprint with the first of them, and the firsts of fingerprints that pigeonhole blocks link."""
    classes = written(texts.groupBy("fp").agg(F.min("copy").alias("first"), F.count("*").alias("n")), "classes")
    hot = hot_values(classes, "fp", "n")
    same = spread_join(texts.select("fp", "copy"), classes.where("n > 1").select("fp", "first"), "fp", hot, "copy").where("copy <> first").select(F.col("first").alias("a"), F.col("copy").alias("b"))
    firsts = classes.select("fp", "first")
    near = close_links(classes.select("fp")).toDF("x", "y").distinct()
    near = near.join(firsts.toDF("x", "a").hint("merge"), "x").join(firsts.toDF("y", "b").hint("merge"), "y").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return same.unionByName(near)


def similar_roots(texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """(node, root) of the components of all pairs at `similarity` or more; texts: copy (distinct), fp (its fingerprint) and blob (the compressed text)."""
    partitions = partitions_for(texts, F.length("blob"), 8 << 20)
    keys = texts.select("copy", "blob").mapInArrow(_prefixes(width, similarity, _common(texts, width)), "key long, copy long, n int, pos int")
    met = keys.repartition(partitions, "key").sortWithinPartitions("key", "copy").mapInArrow(_shared(similarity, WHOLE), "key long, copy long, other long, n int, pos int, rank long, whole boolean")
    met = written(met, "met")
    first = met.where("key is null").select(F.col("copy").alias("a"), F.col("other").alias("b")).unionByName(fingerprint_pairs(texts))
    large = met.where("key is not null")
    bits = _sketches(texts, large, width)
    whole = large.where("whole").select("key", "copy", "n", "pos").join(bits.hint("merge"), "copy").select("key", "copy", "n", "pos", "bits", "more")
    parts = whole.repartition(partitions, "key").sortWithinPartitions("key", "copy").mapInArrow(_parted(similarity), "key long, copy long, n int, pos int, rank long")
    # near copies meet on many shingles; parts of the same members are one, in which each has its first place, so that no pair which may be similar is lost
    parts = parts.groupBy("key", "copy").agg(F.min("n").alias("n"), F.min("pos").alias("pos"), F.min("rank").alias("rank"))
    parts = written(parts.unionByName(large.where("not whole").select(parts.columns)), "parts")
    alive = parts.select("key", "copy", F.col("copy").alias("root"), "n", "pos", "rank")
    low, high, compared, roots, spent, rows = 0, 1, None, None, parts, alive.count()
    with shuffles_for(texts.sparkSession, rows):
        partitions = shuffle_partitions(texts.sparkSession)
    while True:
        pairs = _dealt(alive, bits, low, high, partitions).mapInArrow(_pairs(high, similarity), "a long, b long")
        if compared is None:
            compared = pairs = written(pairs.unionByName(first).distinct(), "pairs")
            discard(met)
        else:
            with shuffles_for(texts.sparkSession, max(rows, compared.count())):
                pairs = written(pairs.distinct().join(compared.hint("merge"), ["a", "b"], "left_anti"), "pairs")
            compared = compared.unionByName(pairs)
        give_back(texts.sparkSession)
        links = _links(texts, pairs, width, similarity)
        found = links.count()
        if roots is None:
            roots = components(links, found)
        elif found:
            # what was linked before is in the roots
            older, roots = roots, components(roots.toDF("a", "b").unionByName(links), roots.count() + found)
            discard(older)
        discard(links)
        if high == _ALL:
            discard(spent, bits)
            return roots
        with shuffles_for(texts.sparkSession, rows):
            left = alive.drop("root").join(roots.hint("merge"), F.col("copy") == roots["node"], "left").select("key", "copy", F.coalesce("root", "copy").alias("root"), "n", "pos", "rank")
            # buckets of several components in which some member has not yet had its turn
            open_ = left.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.max("rank").alias("last"), F.count("*").alias("rows")).where(F.expr("x <> y") & (F.col("last") > high))
            open_ = written(open_.select("key", "rows"), "open")
            n = F.col("rows")
            rows, comparisons = open_.agg(F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.sum(n * (n - 1) / 2), F.lit(0))).first()
            if not rows:
                discard(spent, open_, bits)
                return roots
            alive = written(spread_join(left, open_.select("key"), "key", hot_values(open_, "key", "rows", rows), "copy"), "alive")
        discard(spent, open_)
        spent = alive
        with shuffles_for(texts.sparkSession, rows):
            partitions = shuffle_partitions(texts.sparkSession)
        low, high = high, _ALL if comparisons <= FEW_COMPARISONS else high + 8 * (high - low)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3)
    for piece in pieces(batches, "text", 2 << 20):
        texts = plain(piece, "text")
        own = majority_bits(*shingle_hashes(Words(texts, lower=True), FINGERPRINT_WORDS))
        yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(own.view(np.int64)), pa.array([press.compress(x.encode()) for x in texts.to_pylist()], pa.binary())], ["h", "h2", "fp", "blob"])


def _identity(text: str) -> list[Column]:
    """128 bits that stand for a text (a null one is empty)."""
    whole = F.coalesce(text, F.lit(""))
    return [F.xxhash64(whole).alias("h"), F.xxhash64(F.lit("second"), whole).alias("h2")]


def kept_documents(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, h, h2) of the document to keep of each group; h and h2 are 128 bits of hash of its text.

    Groups are the components of links at `similarity` or more. The document with the least doc_id stays (null ids last, then by hash).
    Rows that agree in doc_id and text are one document. Null and empty texts have no shingles: they are copies of each other
    and of nothing else. An empty table gives an empty table.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_identity("text"), "text")
    # texts without words have no shingles; they are one group
    blank = F.coalesce("text", F.lit("")).rlike(r"^[\x20\x09-\x0D]*$")
    texts = base.where(~blank).select("h", "h2", "text").mapInArrow(_read, "h long, h2 long, fp long, blob binary").groupBy("h", "h2").agg(F.first("fp").alias("fp"), F.first("blob").alias("blob"))
    # different texts get different numbers, whatever their hashes
    texts = written(texts.withColumn("copy", F.monotonically_increasing_id()), "texts")
    roots = similar_roots(texts.select("copy", "fp", "blob"), width, similarity)
    # least documents, first of each text and then of each group: sums of few rows a key, whatever the size of a group
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "h2")
    each = base.groupBy("h", "h2", blank.alias("blank")).agg(F.min(order).alias("kept"))
    each = each.join(texts.select("h", "h2", "copy").hint("merge"), ["h", "h2"], "left")
    grouped = each.join(roots.hint("merge"), each["copy"] == roots["node"], "left")
    root = F.when(F.col("blank"), F.lit(-1)).otherwise(F.coalesce("root", "copy"))
    kept = written(grouped.groupBy(root.alias("root")).agg(F.min("kept").alias("kept")).select("kept.doc_id", "kept.h", "kept.h2"), "kept")
    discard(texts, roots)
    return kept


def drop_near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without near copies: of each group one document stays. See kept_documents(). Of rows that agree in doc_id and text one stays, whichever.

    Other columns of docs stay, whatever their names.
    """
    null_id = F.lit(-(2**63))
    kept = kept_documents(docs, width, similarity).select(F.coalesce("doc_id", null_id).alias("doc"), F.col("doc_id").isNull().alias("none"), "h", "h2")
    # the columns travel under numbers, so that no name can clash
    numbers = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index("text")
    own = docs.select(F.col("doc_id").cast("long").alias("doc"), *[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, numbers)])
    own = own.select("doc", F.col("doc").isNull().alias("none"), *_identity(f"c{at}"), *numbers).withColumn("doc", F.coalesce("doc", null_id))
    # kept documents grow with the input, so they aren't broadcast; repeated rows are joined into one before they are dealt
    single = squeezed(own, f"c{at}").dropDuplicates(["doc", "none", "h", "h2"]).join(kept.hint("merge"), ["doc", "none", "h", "h2"], "left_semi")
    return unsqueezed(single.select(*numbers), f"c{at}").toDF(*docs.columns)
