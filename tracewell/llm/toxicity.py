"""Toxicity by noisy-channel deobfuscation.

1. A character trigram model is counted over the words of all documents.
2. Words that may be disguised (leetspeak, letters set apart, repeated letters) become lattices: each position offers the letters it may
   stand for. Viterbi finds the likeliest word under the character model and the channel's costs. Other words have one path only.
3. The restored text is scored: words and word beginnings carry weights learned from labelled rows (log odds of document frequency), and a
   logistic curve over their sum, their maximum and their density gives the score.

The classifier is fitted on a bounded sample of labelled rows (SAMPLE of each label). The character counts cover all data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.language_id import letter_table
from tracewell.llm.sampling import bounded
from tracewell.llm.store import discard, written
from tracewell.llm.text import Words, bytes_of, mixed, pieces, plain, run_hash

#: Different labelled texts of each label that the classifier is fitted on. They bound its features as well.
SAMPLE = 4000
THRESHOLD = 0.3
#: Letters that a sign may stand for (fixed values).
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "§": "s"}
#: Signs that may set letters apart inside a word (fixed values).
APART = "._-*~'·"
_OUTER = ".,;:!?\"'()[]{}<>*&%#~_-+=/\\|`´’‘“”«»¿¡…"
#: Costs of the channel, as negative log probabilities: a sign for a letter, a letter seen as it is, a doubled letter dropped, a sign dropped.
COST_LEET, COST_SAME, COST_DROP, COST_APART, COST_SIGN = 1.0, 0.05, 0.7, 0.4, 12.0
#: A run of so many words of one letter may be one word set apart.
SPACED = 3
BEGINNINGS = (4, 5)
#: Features of lesser log odds carry no weight.
LEAST_WEIGHT = 2.0


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, "text"):
        words = Words(plain(piece, "text"))
        if not len(words):
            continue
        weight = np.bincount(words.codes, minlength=len(words.unique))
        points, starts = _points(words.unique)
        letter = letter_table()[points]
        points = np.where(letter, points, 0)
        # 21 bits a character; anything but a letter is the boundary 0
        padded = np.concatenate(([0, 0], points)).astype(np.int64)
        code = padded[:-2] << 42 | padded[1:-1] << 21 | padded[2:]
        count = np.repeat(weight, np.diff(starts))
        first = np.zeros(len(points), bool)
        first[starts[:-1]] = True
        second = np.zeros(len(points), bool)
        second[np.minimum(starts[:-1] + 1, len(points) - 1)] = True
        code = np.where(first, points.astype(np.int64), np.where(second, padded[1:-1] << 21 | padded[2:], code))
        seen, where = np.unique(code, return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(np.bincount(where, count).astype(np.int64))], ["code", "n"])


def _points(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of the lower-case words, each with its closing space; where each word begins, one more at the end)."""
    lower = pc.utf8_lower(words.cast(pa.large_string()))
    data, offsets = bytes_of(lower)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    return points, np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]


class CharacterModel:
    """log P(c | a, b) by interpolated trigram, bigram and unigram counts: sorted arrays of all that were counted, 16 bytes a trigram."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        self.tri, self.bi, self.uni = (_summed(codes & mask, counts) for mask in ((1 << 63) - 1, (1 << 42) - 1, (1 << 21) - 1))
        self.all, self.costs = max(1, int(counts.sum())), {}

    def cost(self, a: int, b: int, c: int) -> float:
        code = a << 42 | b << 21 | c
        found = self.costs.get(code)
        if found is None:
            pair = code & (1 << 42) - 1
            p = 0.7 * _between(self.tri, code, 1) / max(1, _between(self.tri, code - c, 1 << 21)) + 0.25 * _between(self.bi, pair, 1) / max(1, _between(self.bi, pair - c, 1 << 21)) + 0.05 * _between(self.uni, c, 1) / self.all
            if len(self.costs) > 200_000:
                self.costs.clear()
            found = self.costs[code] = -float(np.log(p + 1e-7))
        return found


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct codes, ascending; sums of the counts up to each, from 0)."""
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    last = np.flatnonzero(np.diff(codes, append=-1))
    return codes[last], np.concatenate(([0], np.cumsum(counts[order])[last])).astype(np.int64)


def _between(counted: tuple[np.ndarray, np.ndarray], code: int, width: int) -> int:
    """The count of all codes from code to code + width - 1."""
    low, high = np.searchsorted(counted[0], np.array([code, code + width]))
    return int(counted[1][high] - counted[1][low])


def decode(seen: str, model: CharacterModel) -> str:
    """The likeliest word behind a disguised one: Viterbi over the last two letters."""
    paths: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    before = ""
    for c in seen:
        options: list[tuple[str, float]] = []
        if c.isalpha():
            options.append((c, COST_SAME))
            if c == before:
                options.append(("", COST_DROP))
        for letter in LEET.get(c, ""):
            options.append((letter, COST_LEET))
        if c in APART:
            options.append(("", COST_APART))
        if not c.isalpha():
            options.append(("", COST_SIGN))
        after: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (cost, word) in paths.items():
            for letter, own in options:
                if letter:
                    state, total, longer = (b, ord(letter)), cost + own + model.cost(a, b, ord(letter)), word + letter
                else:
                    state, total, longer = (a, b), cost + own, word
                if state not in after or (total, longer) < after[state]:
                    after[state] = (total, longer)
        paths, before = after, c
    return min((cost + model.cost(a, b, 0), word) for (a, b), (cost, word) in paths.items())[1]


def _disguised(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which words hold a sign with a letter behind it, or a letter three times in a row. Words end with a space."""
    letter = letter_table()[points]
    word = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    out = np.zeros(len(starts) - 1, bool)
    signs = np.isin(points, [ord(c) for c in [*LEET, *APART]])
    # a sign with a letter after it in its word
    last = np.full(len(out), -1)
    at = np.flatnonzero(letter)
    last[word[at]] = at
    at = np.flatnonzero(signs)
    out[word[at[at < last[word[at]]]]] = True
    if len(points) > 2:
        at = np.flatnonzero((points[:-2] == points[1:-1]) & (points[1:-1] == points[2:]) & letter[2:])
        out[word[at]] = True
    return out


class Features:
    """Hashed features of restored words: each word and its beginnings."""

    def __init__(self, model: CharacterModel):
        self.model, self.known = model, {}

    def restore(self, word: str) -> str:
        if word not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[word] = decode(word, self.model)
        return self.known[word]

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes: a row for each different word, columns for it and its beginnings as seen and as restored, 0 for none; word of each token; text of each)."""
        words = Words(texts)
        doc = np.repeat(np.arange(len(texts)), np.diff(words.of))
        if not len(words):
            return np.zeros((0, 2 + 2 * len(BEGINNINGS)), np.uint64), words.codes, doc
        unique = pc.utf8_lower(words.unique.cast(pa.large_string()))
        shown = pc.utf8_trim(unique, characters=" " + _OUTER).to_pylist()
        odd = np.flatnonzero(_disguised(*_points(words.unique))).tolist()
        inner = pc.utf8_ltrim(pc.utf8_rtrim(unique.take(pa.array(odd, pa.int64())), characters=" $@+(|" + _OUTER), characters=_OUTER)
        restored = dict(zip(odd, map(self.restore, inner.to_pylist())))
        # runs of single letters are one more word each
        size = np.fromiter(map(len, shown), np.int64, len(shown))
        single = (size == 1)[words.codes]
        edge = np.flatnonzero(np.diff(single.astype(np.int8), prepend=0, append=0))
        long = np.diff(edge)[::2] >= SPACED
        extra, extra_doc = [], []
        for a, b in zip(edge[::2][long].tolist(), edge[1::2][long].tolist()):
            for d in range(int(doc[a]), int(doc[b - 1]) + 1):
                lo, hi = max(a, int(words.of[d])), min(b, int(words.of[d + 1]))
                if hi - lo >= SPACED:
                    extra.append(self.restore("".join(shown[c] for c in words.codes[lo:hi].tolist())))
                    extra_doc.append(d)
        codes = np.concatenate([words.codes, len(shown) + np.arange(len(extra), dtype=np.int64)])
        doc = np.concatenate([doc, np.array(extra_doc, np.int64)])
        shown += extra
        hashes = np.zeros((len(shown), 2 + 2 * len(BEGINNINGS)), np.uint64)
        hashes[:, : 1 + len(BEGINNINGS)] = _hashed(shown)
        if restored:
            hashes[list(restored), 1 + len(BEGINNINGS) :] = _hashed(list(restored.values()))
        return hashes, codes, doc


def _hashed(words: list[str]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    own = np.fromiter(map(digest, words), np.uint64, len(words))
    begun = [np.fromiter((digest(w[:k]) ^ k if len(w) >= k else 0 for w in words), np.uint64, len(words)) for k in BEGINNINGS]
    return np.stack([own, *begun], 1)


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """With the least hash of a text's runs of three words, which near copies mostly share, so that they count as one."""
    for piece in pieces(batches, "text"):
        words = Words(plain(piece, "text"))
        h = mixed(run_hash(words.hashes(), 3)) >> np.uint64(1)
        least = np.zeros(piece.num_rows, np.int64)
        some = np.flatnonzero(np.diff(words.of))
        if len(some):
            least[some] = np.minimum.reduceat(h, words.of[:-1][some]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(least)], ["text", "toxic", "alike"])


def _labelled(character: CharacterModel):
    """(feature, toxic, n): texts with the feature, counted once for texts that share their least shingle (near copies)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(character)
        for piece in pieces(batches, "text", 2 << 20):
            hashes, codes, doc = features.of(plain(piece, "text"))
            label = piece.column(piece.schema.get_field_index("toxic")).to_numpy(zero_copy_only=False).astype(np.int64)
            group = piece.column(piece.schema.get_field_index("alike")).to_numpy(zero_copy_only=False)
            found = []
            for k in range(hashes.shape[1]):
                own = hashes[codes, k].view(np.int64)
                found.append(np.stack([own, doc], 1)[own != 0])
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(label[pairs[:, 1]].astype(np.int32)), pa.array(group[pairs[:, 1]])], ["feature", "toxic", "alike"])

    return run


def log_odds(bad: np.ndarray, good: np.ndarray, all_bad: float, all_good: float, least: int) -> np.ndarray:
    """Weight of features by the toxic and other texts that hold them; 0 where it is small or rests on fewer than `least` toxic texts."""
    weight = np.log((np.maximum(bad, 0) + 0.5) / (all_bad + 1)) - np.log((np.maximum(good, 0) + 0.5) / (all_good + 1))
    return np.where((bad >= least) & (weight > LEAST_WEIGHT), weight, 0)


class Model:
    """Features with the counts of toxic and other texts that hold them, and the curve over a text's evidence."""

    def __init__(self, character: CharacterModel, features: np.ndarray, bad: np.ndarray, good: np.ndarray, totals: tuple[int, int], least: int):
        self.character, self.features, self.counts, self.totals, self.least = character, features, (bad, good), totals, least
        self.weights = log_odds(bad, good, *totals, least)
        self.curve = np.array([-3.0, 0, 0, 0])
        self._of: Features | None = None

    def without(self, label: int) -> np.ndarray:
        """The weights had one text of this label, which holds the feature, not been learned from."""
        (bad, good), (all_bad, all_good) = self.counts, self.totals
        return log_odds(bad - label, good - (1 - label), all_bad - label, all_good - (1 - label), self.least)

    def evidence(self, texts: pa.Array, weights: np.ndarray) -> np.ndarray:
        """For each text: 1, log of 1 + the sum of its words' weights, the greatest weight, 10 times the share of weighted words."""
        if self._of is None:
            self._of = Features(self.character)
        hashes, codes, doc = self._of.of(texts)
        out = np.zeros((len(texts), 4))
        out[:, 0] = 1
        if len(self.features) and len(hashes):
            at = np.minimum(np.searchsorted(self.features, hashes), len(self.features) - 1)
            weight = np.where(self.features[at] == hashes, weights[at], 0).max(1)[codes]
            n = np.bincount(doc, minlength=len(texts))
            out[:, 1] = np.log1p(np.bincount(doc, weight, len(texts)))
            np.maximum.at(out[:, 2], doc, weight)
            out[:, 3] = 10 * np.bincount(doc, weight > 0, len(texts)) / np.maximum(n, 1)
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.evidence(texts, self.weights) @ self.curve, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton's method; the ridge holds all weights but the first."""
    w, hold = np.zeros(x.shape[1]), ridge * np.diag([1e-3] + [1.0] * (x.shape[1] - 1)) * max(1, len(x)) / 10
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold, x.T @ (p - y) + hold @ w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def character_model(docs: DataFrame) -> CharacterModel:
    """Counts over the words of every text, all of them: they grow with the different letter triples of the texts."""
    counted = docs.select("text").where("text is not null").mapInArrow(_trigrams, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    kept = counted.toArrow()
    return CharacterModel(kept.column("code").to_numpy(), kept.column("n").to_numpy())


def fit(labelled: DataFrame, docs: DataFrame, sample: int = SAMPLE) -> Model:
    """labelled: text and toxic (0 or 1; rows null in either are passed over), of which `sample` different texts a label are learned from; docs: all texts, for the character model."""
    character = character_model(docs)
    rows = bounded(labelled.select("text", F.col("toxic").cast("int").alias("toxic")).where("text is not null and toxic in (0, 1)"), "toxic", sample).select("text", "toxic")
    rows = written(rows.mapInArrow(_alike, "text string, toxic int, alike long"), "labelled")
    groups = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count_distinct("alike").alias("n")).collect()}
    totals = groups.get(1, 0), groups.get(0, 0)
    least = max(2, round(0.002 * totals[0]))
    seen = rows.mapInArrow(_labelled(character), "feature long, toxic int, alike long").groupBy("feature").agg(
        F.count_distinct(F.when(F.col("toxic") == 1, F.col("alike"))).alias("bad"), F.count_distinct(F.when(F.col("toxic") == 0, F.col("alike"))).alias("good")
    )
    odds = (F.col("bad") + 0.5) * (totals[1] + 1) / (F.col("good") + 0.5) / (totals[0] + 1)
    kept = seen.where((F.col("bad") >= least) & (F.log(odds) > LEAST_WEIGHT / 2)).toArrow()
    features = kept.column("feature").to_numpy().view(np.uint64)
    order = np.argsort(features)
    model = Model(character, features[order], kept.column("bad").to_numpy()[order], kept.column("good").to_numpy()[order], totals, least)
    left_out = [model.without(0), model.without(1)]

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", 2 << 20):
            label = piece.column(1).to_numpy()
            texts, found = plain(piece, "text"), np.zeros((piece.num_rows, 4))
            for own in (0, 1):
                mine = np.flatnonzero(label == own)
                found[mine] = model.evidence(texts.take(pa.array(mine)), left_out[own])
            yield pa.RecordBatch.from_arrays([piece.column(1), *(pa.array(found[:, k]) for k in range(4))], ["toxic", "a", "b", "c", "d"])

    rest = rows.select("text", "toxic").mapInArrow(evidence, "toxic int, a double, b double, c double, d double").collect()
    discard(rows)
    if rest:
        found = np.array([tuple(r) for r in rest], float)
        model.curve = logistic(found[:, 1:], found[:, 0])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= THRESHOLD, else 0).

    A null text counts as empty; a text without words gets the score of no evidence. Only text is looked at. Repeated rows and
    an empty table need no care; columns of docs that bear the new names are replaced.
    """
    docs = docs.drop("score", "predicted")
    columns = [f"c{i}" for i in range(len(docs.columns))]
    text = f"c{docs.columns.index('text')}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text, 2 << 20):
            found = model.score(plain(piece, text))
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))], [*columns, "score", "predicted"])

    ddl = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(columns, docs.schema.fields)) + ", score double, predicted int"
    made = docs.toDF(*columns).mapInArrow(run, ddl)
    return made.select(*[F.col(c).alias(n) for c, n in zip(columns, docs.columns)], "score", "predicted")
