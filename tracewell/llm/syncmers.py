"""Document fingerprints from closed syncmers.

A k-mer of characters is a closed syncmer if the least of its s-mers (by hash) is its first or last. That depends on the k-mer alone, so an edit moves no
anchor outside its reach. The fingerprint holds the SKETCH anchors of least hash with their places; two fingerprints are as alike as the part of
their joint least anchors that both hold at about the same place.
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
from tracewell.llm.text import mixed, pieces, plain, run_hash, window_least

K, S, SKETCH = 16, 5, 64
#: Texts of fewer than SHORT characters have so few anchors of K that they use these. Longer texts hold them as well, to be compared with short ones.
SHORT, SHORT_K, SHORT_S = 96, 6, 2
#: Anchors match if their places differ by at most SHIFT characters and 1 / SHIFT_PART of the longer text.
SHIFT, SHIFT_PART = 32, 16
_NULL_ID = -(2**63)
_DEALT = "region int, last boolean, doc_id long, copy long, blob binary"


def fingerprint(texts: list[str]) -> list[str]:
    """Per text the number of characters and its anchors of least hash, each 8 hex digits and the place in hex. The empty text: ''.

    The number of characters of a text of SHORT or more is followed by a slash and its anchors of SHORT_K, divided by points.
    A text without an anchor (shorter than its k, say) has one, the hash of its whole.
    """
    long = [i for i, x in enumerate(texts) if len(x) >= SHORT]
    out = ["-".join([f"{len(x):x}", *own]) if x else "" for x, own in zip(texts, _anchors(texts, SHORT_K, SHORT_S))]
    for i, own in zip(long, _anchors([texts[i] for i in long], K, S)):
        size, *small = out[i].split("-")
        out[i] = "-".join([f"{size}/{'.'.join(small)}", *own])
    return out


def _anchors(texts: list[str], k: int, s: int) -> list[list[str]]:
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(n) - n
    small = mixed(run_hash(points + np.uint64(1), s), 11)
    least = window_least(small, k - s + 1)
    edge = small == least
    edge[: len(edge) - (k - s)] |= small[k - s :] == least[: max(0, len(least) - (k - s))]
    at = np.flatnonzero(edge)
    doc = np.searchsorted(begin, at, "right") - 1
    inside = at + k <= (begin + n)[doc]
    at, doc = at[inside], doc[inside]
    hashes = mixed(run_hash(points + np.uint64(1), k)[at], 12) >> np.uint64(32)
    # long texts: most anchors cannot be among the least
    count = np.bincount(doc, minlength=len(texts))
    low = hashes < (2.0**32 * np.minimum(1, 4 * SKETCH / np.maximum(count, 1)))[doc]
    # only if different ones fill the sketch; a repeated passage repeats its anchors
    pairs = np.unique(doc[low].astype(np.uint64) << np.uint64(32) | hashes[low])
    enough = np.bincount((pairs >> np.uint64(32)).astype(np.int64), minlength=len(texts)) >= SKETCH
    keep = low | ~enough[doc]
    at, doc, hashes = at[keep], doc[keep], hashes[keep]
    order = np.lexsort((at, hashes, doc))
    at, doc, hashes = at[order] - begin[doc[order]], doc[order], hashes[order]
    new = np.ones(len(at), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    at, doc, hashes = at[new], doc[new], hashes[new]
    rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
    keep = rank < SKETCH
    at, doc, hashes = at[keep].tolist(), doc[keep], hashes[keep].tolist()
    cuts = np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
    anchors = [f"{h:08x}{p:x}" for h, p in zip(hashes, at)]
    out = []
    for i, text in enumerate(texts):
        own = anchors[cuts[i] : cuts[i + 1]]
        if not own and text:
            own = [f"{int(hashlib.sha256(text.encode()).hexdigest()[:8], 16):08x}0"]
        out.append(own)
    return out


def likeness(a: str, b: str) -> float:
    """0 to 1: the part of the joint anchors of least hash that both fingerprints hold at about the same place.

    A text under SHORT characters is compared by anchors of SHORT_K with every other.
    """
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    size_a, *own_a = a.split("-")
    size_b, *own_b = b.split("-")
    (size_a, _, small_a), (size_b, _, small_b) = size_a.partition("/"), size_b.partition("/")
    if bool(small_a) != bool(small_b):
        own_a, own_b = small_a.split(".") if small_a else own_a, small_b.split(".") if small_b else own_b
    held_a, held_b = {x[:8]: int(x[8:], 16) for x in own_a}, {x[:8]: int(x[8:], 16) for x in own_b}
    # a full sketch says nothing of hashes above its last
    limit = min([own[-1][:8] for own in (own_a, own_b) if len(own) == SKETCH], default="g")
    joint = {x for x in held_a.keys() | held_b.keys() if x <= limit}
    most = SHIFT + max(int(size_a, 16), int(size_b, 16)) // SHIFT_PART
    same = sum(1 for x in joint if x in held_a and x in held_b and abs(held_a[x] - held_b[x]) <= most)
    return same / len(joint) if joint else 0.0


def edited(text: str, after: str) -> str:
    """The last quarter (rounded down) replaced by as many first characters of the next text, or all it has."""
    part = len(text) // 4
    return text[: len(text) - part] + after[:part]


def _deal(bounds: list[int], heads: dict[int, int]):
    """Rows to the region of their doc_id; a region's first row goes to the region before it as well, marked last."""
    edges = np.array(bounds, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for piece in pieces(batches, "text", 8 << 20):
            ids = piece.column(0).to_numpy()
            region = np.searchsorted(edges, ids, "right")
            twice = np.array([i for i, d in enumerate(ids.tolist()) if d in heads], np.int64)
            blobs = [press.compress(x.encode()) for x in plain(piece, "text").to_pylist()]
            at = np.concatenate([np.arange(len(ids)), twice])
            target = np.concatenate([region, np.array([heads[ids[i]] for i in twice.tolist()], np.int64)]).astype(np.int32)
            last = np.arange(len(at)) >= len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(target), pa.array(last), pa.array(ids[at]), pa.array(piece.column(1).to_numpy()[at]), pa.array([blobs[i] for i in at.tolist()])], ["region", "last", "doc_id", "copy", "blob"])

    return run


def _print(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    opened = zstandard.ZstdDecompressor()
    held: list[tuple[int, str, str | None]] = []  # (doc_id, text, its fingerprint if known)
    size, done = 0, False

    def result() -> pa.RecordBatch:
        ids, texts, known = [x[0] for x in held], [x[1] for x in held], [x[2] for x in held]
        changed = [edited(a, b) for a, b in zip(texts[:-1], texts[1:])]
        first = 1 if known[0] is not None else 0
        own = known[:first] + fingerprint(texts[first:])
        other = fingerprint(changed)
        held[:] = [(ids[-1], texts[-1], own[-1])]
        n = len(changed)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([None if i == _NULL_ID else i for i in ids[:n]], pa.int64()),
                pa.array([len(x) for x in texts[:n]], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed]),
                pa.array(own[:n]),
                pa.array(other),
                pa.array([likeness(a, b) for a, b in zip(own, other)]),
                pa.array([likeness(a, b) for a, b in zip(own[:-1], own[1:])]),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    for batch in batches:
        if done:
            continue
        for last, doc_id, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(4)):
            text = opened.decompress(blob.as_py()).decode()
            held.append((doc_id, text, None))
            size += len(text)
            done = last
            if len(held) > 1 and (size > 1 << 20 or done):
                yield result()
                size = 0
            if done:
                break


def fingerprints_and_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited (to the edited text), near_next (to the next document).

    Documents are in ascending order of doc_id; null ids come first, equal ids are ordered by a hash of their texts, and after the last comes
    the first (a single document is its own next). A null text counts as empty; its fingerprint is ''. Equal texts have equal fingerprints.
    An empty table gives an empty table. Other columns are not read. Rows go to ranges of doc_id, one shuffle of compressed texts; each
    range also gets the first row of the next one, so none needs to see another.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("copy"), "text")
    regions = shuffle_partitions(docs.sparkSession)
    found = rows.agg(F.percentile_approx("doc_id", [i / regions for i in range(1, regions)] or [0.5], 20 * regions).alias("bounds")).first()["bounds"] or []
    edges = sorted(set(found))[: regions - 1]

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.sort(batch.column(0).to_numpy())
            region = np.searchsorted(np.array(edges, np.int64), ids, "right")
            new = np.flatnonzero(np.diff(region, prepend=-1))
            yield pa.RecordBatch.from_arrays([pa.array(region[new].astype(np.int32)), pa.array(ids[new])], ["region", "doc_id"])

    # one row a region
    heads = sorted((r["region"], r["head"]) for r in rows.select("doc_id").mapInArrow(firsts, "region int, doc_id long").groupBy("region").agg(F.min("doc_id").alias("head")).collect())
    before = {head: heads[i - 1][0] for i, (_, head) in enumerate(heads)}
    dealt = rows.mapInArrow(_deal(edges, before), _DEALT).repartitionById(max(1, len(edges) + 1), "region").sortWithinPartitions("last", "doc_id", "copy")
    return dealt.mapInArrow(_print, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
