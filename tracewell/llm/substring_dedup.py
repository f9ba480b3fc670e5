"""Substring dedup by super-k-mer partitioning.

A window is `window` consecutive words of one document. Each word covered by a window whose word sequence also starts
earlier (smaller doc_id, or same document and earlier start) is removed.

1. Every document is cut into super-k-mers: runs of consecutive windows that share a minimiser (the least hash among the
   runs of `MINIMISER` words inside the window). A super-k-mer travels as one packed string, once for its 20-word overlap
   and not once a window, to the bucket of its minimiser; equal windows have equal minimisers and so meet there.
2. Equal super-k-mers of one batch are sent once; the later ones are known to be repeats at once.
3. In a bucket the windows are sorted by hash, then by place; equal hashes are compared word for word, so counts are exact.
   All windows but the first of each group are repeats.
4. Repeats return to their documents as word ranges.

Skew: minimisers whose distinct super-k-mers would fill a large part of a bucket are found beforehand on a hash sample of the
documents; windows under them travel one by one, by the hash of the whole window. The sample changes only the route: a window's
route depends on nothing but its words, so results are exact whatever the sample holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.store import shuffle_partitions
from tracewell.llm.text import Words, map_large_arrays, mixed, pieces, plain, run_hash, spans, squeezed, window_least

WINDOW = 20
#: Words of a minimiser.
MINIMISER = 3
#: Parts into which a shuffle partition is sorted, so that a task holds one of them at a time.
PARTS = 6
#: One document in so many is looked at for hot minimisers.
HOT_SAMPLE = 16

_PACKED = "part int, sub int, blob binary, doc_id long, copy long, start long, windows long"
_REPEATS = "doc_id long, copy long, start long, windows long"
_NULL_ID = -(2**63)


def _cut(words: Words, window: int) -> tuple[np.ndarray, ...]:
    """(document, first word, windows, minimiser) of each super-k-mer, and the window hashes of the whole batch."""
    h = words.hashes()
    of = words.of
    doc = np.repeat(np.arange(len(of) - 1), np.diff(of))
    least = window_least(mixed(run_hash(h, MINIMISER), 1), window - MINIMISER + 1)
    whole = np.arange(len(h)) + window <= of[doc + 1] if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    if len(at) == 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), h
    new = np.ones(len(at), bool)
    new[1:] = (least[at[1:]] != least[at[:-1]]) | (doc[at[1:]] != doc[at[:-1]])
    first = np.flatnonzero(new)
    return doc[at[first]], at[first], np.diff(np.append(first, len(at))), least[at[first]], run_hash(h, window)


def _hot_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", 2 << 20):
            words = Words(plain(piece, "text"))
            _, at, windows, least, hashes = _cut(words, window)
            # a super-k-mer is told from others by its first and last window
            mark = mixed(hashes[at], 2) ^ mixed(hashes[at + windows - 1], 3) if len(at) else least
            pairs = np.unique(np.stack([least.view(np.int64), mark.view(np.int64)], 1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["least", "mark"])

    return run


def hot_minimisers(docs: DataFrame, partitions: int, window: int = WINDOW) -> list[int]:
    """Minimisers expected to bring over half a partition's mean of distinct super-k-mers; at most 2 * partitions of them."""
    sample = docs.where(F.pmod(F.xxhash64("doc_id", "copy"), F.lit(HOT_SAMPLE)) == 0).select("text")
    counts = sample.mapInArrow(_hot_rows(window), "least long, mark long").distinct().groupBy("least").agg(F.count("*").alias("n"))
    found = counts.where("n > 30").orderBy(F.desc("n")).limit(2 * partitions).collect()
    total = counts.agg(F.sum("n")).first()[0] if found else 0
    return [r["least"] for r in found if r["n"] * 2 * partitions > total]


def _pack(window: int, partitions: int, hot: list[int]):
    hot_keys = np.sort(np.array(hot, np.int64).view(np.uint64)) if hot else np.zeros(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        map_large_arrays()
        press = zstandard.ZstdCompressor(level=6)
        for piece in pieces(batches, "text", 2 << 20):
            words = Words(plain(piece, "text"))
            doc, at, windows, key, hashes = _cut(words, window)
            if len(at) == 0:
                continue
            if len(hot_keys):
                is_hot = np.isin(key, hot_keys)
                single = spans(at[is_hot], windows[is_hot])
                doc = np.concatenate([doc[~is_hot], np.repeat(doc[is_hot], windows[is_hot])])
                at = np.concatenate([at[~is_hot], single])
                key = np.concatenate([key[~is_hot], mixed(hashes[single], 4)])
                windows = np.concatenate([windows[~is_hot], np.ones(len(single), np.int64)])
            ids = piece.column(piece.schema.get_field_index("doc_id")).fill_null(_NULL_ID).to_numpy(zero_copy_only=False)
            copies = piece.column(piece.schema.get_field_index("copy")).to_numpy(zero_copy_only=False)
            # earliest place first, so that the first of equal strings is the one to keep
            order = np.lexsort((at, copies[doc], ids[doc]))
            doc, at, windows, key = doc[order], at[order], windows[order], key[order]
            flat, begin = words.flat.tobytes(), words.begin
            lo, hi = begin[at].tolist(), (begin[at + windows + window - 1] - 1).tolist()
            packed = [flat[a:b] for a, b in zip(lo, hi)]
            seen: dict[bytes, int] = {}
            first = np.fromiter((seen.setdefault(s, i) for i, s in enumerate(packed)), np.int64, len(packed))
            sent = first == np.arange(len(packed))
            same = (ids[doc] == ids[doc[first]]) & (copies[doc] == copies[doc[first]]) & (at - words.of[doc] == at[first] - words.of[doc[first]])
            again = np.flatnonzero(~sent & ~same)
            route = (mixed(key, 5) % np.uint64(partitions * PARTS)).astype(np.int64)
            keep = np.flatnonzero(sent)
            keep = keep[np.argsort(route[keep], kind="stable")]
            cuts = np.flatnonzero(np.diff(route[keep], prepend=-1, append=-1))
            rows: list[bytes] = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                own = keep[a:b]
                used, ref = np.unique(doc[own], return_inverse=True)
                head = [np.array([len(own), len(used)], np.int64), ids[used], copies[used], ref.astype(np.int32), (at[own] - words.of[doc[own]]).astype(np.int32), windows[own].astype(np.int32)]
                rows.append(press.compress(b"".join(x.tobytes() for x in head) + b"\n".join([packed[i] for i in own.tolist()])))
            target = route[keep[cuts[:-1]]]
            n, m = len(rows), len(again)
            spread = (mixed(np.arange(m, dtype=np.uint64)) % np.uint64(partitions)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([(target // PARTS).astype(np.int32), spread])),
                    pa.array(np.concatenate([(target % PARTS).astype(np.int32), np.full(m, -1, np.int32)])),
                    pa.array(rows + [None] * m, pa.binary()),
                    pa.array(np.concatenate([np.zeros(n, np.int64), ids[doc[again]]])),
                    pa.array(np.concatenate([np.zeros(n, np.int64), copies[doc[again]]])),
                    pa.array(np.concatenate([np.zeros(n, np.int64), at[again] - words.of[doc[again]]])),
                    pa.array(np.concatenate([np.zeros(n, np.int64), windows[again]])),
                ],
                names=["part", "sub", "blob", "doc_id", "copy", "start", "windows"],
            )

    return run


def _ranges(doc: np.ndarray, copy: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Consecutive window starts as (start, windows)."""
    order = np.lexsort((start, copy, doc))
    doc, copy, start = doc[order], copy[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (copy[1:] != copy[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(doc)))
    return pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(copy[first]), pa.array(start[first]), pa.array(count)], ["doc_id", "copy", "start", "windows"])


def _repeats_of(blobs: list[bytes], window: int) -> pa.RecordBatch | None:
    """The repeated windows among the super-k-mers of one bucket."""
    opened = zstandard.ZstdDecompressor()
    ids, copies, starts, windows, packed = [], [], [], [], []
    for blob in blobs:
        raw = opened.decompress(blob)
        n, m = np.frombuffer(raw, np.int64, 2)
        at = 16
        own_ids, own_copies = np.frombuffer(raw, np.int64, m, at), np.frombuffer(raw, np.int64, m, at + 8 * m)
        at += 16 * m
        ref, start, count = (np.frombuffer(raw, np.int32, n, at + 4 * n * i) for i in range(3))
        ids.append(own_ids[ref])
        copies.append(own_copies[ref])
        starts.append(start)
        windows.append(count)
        packed += raw[at + 12 * n :].split(b"\n")
    doc, copy = np.concatenate(ids), np.concatenate(copies)
    start, count = np.concatenate(starts).astype(np.int64), np.concatenate(windows).astype(np.int64)
    order = np.lexsort((start, copy, doc))
    doc, copy, start, count = doc[order], copy[order], start[order], count[order]
    words = Words(pa.array([b"\n".join([packed[i] for i in order.tolist()])], pa.large_binary()).cast(pa.large_string()))
    lengths = count + window - 1
    at = spans(np.cumsum(lengths) - lengths, count)
    owner = np.repeat(np.arange(len(count)), count)
    place = spans(start, count)
    keys = run_hash(words.hashes(), window)[at]
    by = np.argsort(keys, kind="stable")
    ordered = keys[by]
    new = np.ones(len(by), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    group = np.cumsum(new) - 1
    head = by[np.flatnonzero(new)][group]
    later = np.flatnonzero(~new)
    if len(later) == 0:
        return None
    codes = words.codes
    mine, theirs = by[later], head[later]
    equal = np.ones(len(later), bool)
    for k in range(window):
        equal &= codes[at[mine] + k] == codes[at[theirs] + k]
    if not equal.all():  # two sequences of one hash: told apart by their words
        odd = np.isin(group[later], group[later][~equal])
        first: dict[tuple, int] = {}
        for g in np.unique(group[later][odd]):
            for w in by[group == g].tolist():
                first.setdefault(tuple(codes[at[w] : at[w] + window]), w)
        theirs = theirs.copy()
        theirs[odd] = [first[tuple(codes[at[w] : at[w] + window])] for w in mine[odd].tolist()]
    a, b = owner[mine], owner[theirs]
    repeat = (mine != theirs) & ~((doc[a] == doc[b]) & (copy[a] == copy[b]) & (place[mine] == place[theirs]))
    mine, a = mine[repeat], a[repeat]
    return _ranges(doc[a], copy[a], place[mine]) if len(mine) else None


def _judge(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        map_large_arrays()
        bucket, blobs = None, []
        for batch in batches:
            subs = batch.column(1).to_numpy(zero_copy_only=False)
            parts = batch.column(0).to_numpy(zero_copy_only=False)
            passed = pa.array(subs < 0)
            if (subs < 0).any():
                yield pa.RecordBatch.from_arrays([batch.column(i).filter(passed) for i in range(3, 7)], ["doc_id", "copy", "start", "windows"])
            for i in np.flatnonzero(subs >= 0).tolist():
                if (parts[i], subs[i]) != bucket:
                    if blobs and (found := _repeats_of(blobs, window)) is not None:
                        yield found
                    bucket, blobs = (parts[i], subs[i]), []
                blobs.append(batch.column(2)[i].as_py())
        if blobs and (found := _repeats_of(blobs, window)) is not None:
            yield found

    return run


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Ranges of repeated windows: doc_id (null as the least long), copy, start (word), windows.

    docs has doc_id, copy (a hash of the text, which tells rows of one doc_id apart) and text.
    """
    partitions = shuffle_partitions(docs.sparkSession)
    hot = hot_minimisers(docs, partitions, window)
    packed = docs.select("doc_id", "copy", "text").mapInArrow(_pack(window, partitions, hot), _PACKED)
    dealt = packed.repartitionById(partitions, "part").sortWithinPartitions("part", "sub")
    return dealt.mapInArrow(_judge(window), _REPEATS)


def _strip(keep_text: bool, window: int, schema: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        map_large_arrays()
        opened = zstandard.ZstdDecompressor()
        for piece in pieces(batches, "text", 2 << 20):
            words = Words(pa.array([opened.decompress(x).decode() if x is not None else "" for x in piece.column(piece.schema.get_field_index("text")).to_pylist()], pa.string()))
            n = np.diff(words.of)
            found = piece.column(piece.schema.get_field_index("found"))
            per = found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            inner = found.flatten()
            start, count = (inner.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
            at = words.of[np.repeat(np.arange(len(n)), per)] + start
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + count + window - 1, -1)
            gone = np.cumsum(edge[:-1]) > 0
            removed = np.concatenate(([0], np.cumsum(gone)))[words.of]
            removed = np.diff(removed)
            kept_bytes = words.flat[np.repeat(~gone, np.diff(words.begin))]
            lengths = np.where(gone, 0, np.diff(words.begin))
            ends = np.concatenate(([0], np.cumsum(lengths)))[words.of]
            raw = kept_bytes.tobytes()
            texts = [raw[a : max(a, b - 1)] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            out = {"n_words": pa.array(n), "n_removed": pa.array(removed)}
            if keep_text:
                out["kept_text"] = pa.array([x.decode() for x in texts])
            else:
                out["kept_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in texts])
            yield pa.RecordBatch.from_arrays([out[c] if c in out else piece.column(piece.schema.get_field_index(c)) for c in schema], schema)

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, keep_text: bool = True) -> DataFrame:
    """docs with n_words, n_removed and, in place of text, kept_text (the kept words joined by one space), or kept_sha256 if not keep_text.

    A null text has no words. A null doc_id comes before all others. Rows that agree in doc_id and text are one document:
    each gets that document's result. Rows that agree in doc_id only are ordered by a hash of their text. Documents of fewer
    than `window` words lose nothing. An empty table gives an empty table. Other columns of docs stay, whatever their names, but for
    those named as the results, which are replaced. Texts are compressed on their way to their repeats.
    """
    made = ["n_words", "n_removed", "kept_text" if keep_text else "kept_sha256"]
    docs = docs.drop("n_words", "n_removed", "kept_text", "kept_sha256")
    own = docs.select(F.coalesce("doc_id", F.lit(_NULL_ID)).cast("long").alias("doc_id"), F.xxhash64("text").alias("copy"), "text")
    repeats = repeated_windows(own, window).groupBy("doc_id", "copy").agg(F.collect_list(F.struct("start", "windows")).alias("found"))
    # the columns travel under numbers, so that no name can clash
    kept = [i for i, c in enumerate(docs.columns) if c != "text"]
    numbered = docs.select(*[F.col(f"`{docs.columns[i]}`").alias(f"c{i}") for i in kept], F.coalesce("doc_id", F.lit(_NULL_ID)).cast("long").alias("__doc"), F.xxhash64("text").alias("__copy"), "text")
    found = repeats.toDF("__doc", "__copy", "found").hint("merge")  # repeats grow with the input, so they aren't broadcast
    joined = squeezed(numbered, "text").join(found, ["__doc", "__copy"], "left")
    names = [f"c{i}" for i in kept]
    ddl = ", ".join([f"c{i} {docs.schema[docs.columns[i]].dataType.simpleString()}" for i in kept] + ["n_words long", "n_removed long", f"{made[2]} string"])
    result = joined.select(*names, "text", "found").mapInArrow(_strip(keep_text, window, [*names, *made]), ddl)
    return result.select(*[F.col(f"c{i}").alias(docs.columns[i]) for i in kept], *made)
