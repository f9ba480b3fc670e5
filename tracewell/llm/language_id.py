"""Language ID by nearest centroid.

A text is a normalised TF-IDF vector of its character 1- to 3-grams (hashed to DIMENSIONS places). Each language has several centroids,
clustered by spherical k-means on a bounded sample of labelled rows; a text takes the language of the centroid with the greatest
cosine. A text farther from it than nearly all training texts of its length were from theirs is rejected.

Document frequencies cover every training row; the sample is only for clustering. The model is one small matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.sampling import bounded
from tracewell.llm.text import bytes_of, once, pieces, plain

DIMENSIONS = 4096
CLUSTERS = 4
#: Different training texts of each language that are clustered.
SAMPLE = 500
#: Lower edges of the length classes (letters and the spaces between words).
LENGTHS = (0, 8, 16, 32, 64, 128, 256, 512, 1024)
#: A text is rejected below this part of the least cosine (but for REJECT_TAIL) of training texts of its length.
REJECT_PART = 0.5
REJECT_TAIL = 0.005
UNKNOWN = "und"
#: Texts whose vectors are held at a time.
ROWS = 256

def letter_table() -> np.ndarray:
    """Which code points are letters."""
    return once("letters", lambda: np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))


def letters_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(lower-case letters as code points, with one 0 before and after each word; the text each belongs to)."""
    texts = pc.binary_join_element_wise(pa.scalar(" ", texts.type), pc.utf8_lower(texts), pa.scalar(" ", texts.type), pa.scalar("", texts.type))
    data, offsets = bytes_of(texts)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    owner = np.repeat(np.arange(len(texts)), np.diff(lead))
    own = np.where(letter_table()[points], points, 0)
    keep = np.ones(len(own), bool)
    keep[1:] = (own[1:] != 0) | (own[:-1] != 0) | (owner[1:] != owner[:-1])
    return own[keep].astype(np.uint64), owner[keep]


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(counts of hashed grams, one row a text; letters and spaces of each text, 0 if it has no letter)."""
    points, owner = letters_of(texts)
    n = len(texts)
    codes = []
    h = points * np.uint64(0x9E3779B97F4A7C15)
    for size in (1, 2, 3):
        if size > 1:
            h = h[:-1] * np.uint64(0xD6E8FEB86659FD93) + points[size - 1 :]
        count = max(0, len(points) - size + 1)
        inner = owner[:count] == owner[len(owner) - count :]
        if size == 1:
            inner = points != 0
        place = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - 12)).astype(np.int64)
        codes.append(owner[:count][inner] * DIMENSIONS + place[inner])
    counts = np.bincount(np.concatenate(codes), minlength=n * DIMENSIONS).reshape(n, DIMENSIONS)
    some = np.bincount(owner[points != 0], minlength=n) > 0
    return counts.astype(np.float32), np.where(some, np.bincount(owner, minlength=n) - 2, 0)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found, rows = np.zeros(DIMENSIONS, np.int64), 0
    for piece in pieces(batches, "text", 1 << 20, ROWS):
        counts, _ = grams(plain(piece, "text"))
        found += (counts > 0).sum(0)
        rows += len(counts)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMENSIONS + 1, dtype=np.int32)), pa.array(np.append(found, rows))], ["place", "n"])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, "text", 1 << 20, ROWS):
        counts, length = grams(plain(piece, "text"))
        press = zstandard.ZstdCompressor(level=3)
        packed = pa.array([press.compress(x.tobytes()) for x in counts.astype(np.uint32)], pa.binary())
        yield pa.RecordBatch.from_arrays([piece.column(piece.schema.get_field_index("lang")), packed, pa.array(length)], ["lang", "counts", "length"])


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; the first centre is the mean, each further one the vector farthest from those before."""
    centres = [x.mean(0)]
    while len(centres) < min(k, len(x)):
        near = np.max(x @ np.stack([c / max(np.linalg.norm(c), 1e-9) for c in centres]).T, 1)
        centres.append(x[int(np.argmin(near))])
    own = np.stack(centres)
    for _ in range(rounds):
        own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)
        nearest = np.argmax(x @ own.T, 1)
        own = np.stack([x[nearest == i].mean(0) if (nearest == i).any() else own[i] for i in range(len(own))])
    return own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)


class Model:
    """idf, centroids with their languages, and the least cosine accepted for each length class."""

    def __init__(self, idf: np.ndarray, centroids: np.ndarray, languages: list[str], least: np.ndarray):
        self.idf, self.centroids, self.languages, self.least = idf, centroids, languages, least

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, cosine, rejected) of each text; no letters, or no language learned: UNKNOWN, 0, rejected."""
        counts, length = grams(texts)
        if not self.languages:
            return [UNKNOWN] * len(counts), np.zeros(len(counts)), np.ones(len(counts), bool)
        near = vectors(counts, self.idf) @ self.centroids.T
        best = near.argmax(1)
        some = length > 0
        score = np.where(some, np.clip(near[np.arange(len(near)), best], 0, 1), 0).astype(np.float64)
        rejected = ~some | (score < self.least[np.searchsorted(LENGTHS, length, "right") - 1])
        return [self.languages[b] if s else UNKNOWN for b, s in zip(best.tolist(), some.tolist())], score, rejected


def fit(rows: DataFrame, sample: int = SAMPLE, clusters: int = CLUSTERS) -> Model:
    """Learn from rows with lang and text; rows null in either are passed over. `sample` bounds the clustered texts of a language; over sampling.LABELS languages are an error."""
    rows = rows.select("lang", "text").where("lang is not null and text is not null")
    counted = rows.select("text").mapInArrow(_frequencies, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(DIMENSIONS + 1)
    for r in counted:
        found[r["place"]] = r["n"]
    idf = np.log((found[-1] + 1) / (found[:-1] + 1)).astype(np.float32) + 0.05
    drawn = bounded(rows, "lang", sample).mapInArrow(_sampled, "lang string, counts binary, length long").where("length > 0").collect()
    by: dict[str, list[int]] = {}
    for i, r in enumerate(drawn):
        by.setdefault(r["lang"], []).append(i)
    if not by:
        return Model(idf, np.zeros((0, DIMENSIONS), np.float32), [], np.zeros(len(LENGTHS)))
    opened = zstandard.ZstdDecompressor()
    x = vectors(np.stack([np.frombuffer(opened.decompress(r["counts"]), np.uint32) for r in drawn]).astype(np.float32), idf)
    centroids, names, near = [], [], np.zeros(len(x))
    for lang in sorted(by):
        own = cluster(x[by[lang]], clusters)
        near[by[lang]] = (x[by[lang]] @ own.T).max(1)
        centroids.append(own)
        names += [lang] * len(own)
    length = np.searchsorted(LENGTHS, [r["length"] for r in drawn], "right") - 1
    least = np.zeros(len(LENGTHS))
    for i in range(len(LENGTHS)):  # a class of few texts takes those of the shorter ones
        own = near[length == i] if (length == i).sum() >= 20 else near[length <= i]
        least[i] = REJECT_PART * np.quantile(own, REJECT_TAIL) if len(own) else 0
    return Model(idf, np.concatenate(centroids).astype(np.float32), names, least)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score (the cosine, 0 to 1) and rejected.

    A null text, and one without letters, is `und`, 0, rejected. Only text is looked at. Repeated rows and an empty table need no care;
    columns of docs that bear the new names are replaced.
    """
    docs = docs.drop("lang_pred", "score", "rejected")
    columns = [f"c{i}" for i in range(len(docs.columns))]
    text = f"c{docs.columns.index('text')}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text, 1 << 20, ROWS):
            languages, score, rejected = model.predict(plain(piece, text))
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(languages, pa.string()), pa.array(score), pa.array(rejected)], [*columns, "lang_pred", "score", "rejected"])

    ddl = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(columns, docs.schema.fields)) + ", lang_pred string, score double, rejected boolean"
    made = docs.toDF(*columns).mapInArrow(run, ddl)
    return made.select(*[F.col(c).alias(n) for c, n in zip(columns, docs.columns)], "lang_pred", "score", "rejected")
