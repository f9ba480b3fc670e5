"""Nearest centroids by plain loops, syncmers by definition with the sketch's error, and Viterbi against all readings of short words."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from llm_common import awkward, prose
from pyspark.sql import functions as F

from tracewell.llm import language_id, syncmers, toxicity
from tracewell.llm.text import mixed, run_hash

M64 = (1 << 64) - 1


def gram_counts(text):
    """(place -> count, letters and inner spaces) of one text, gram by gram."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    points = [0]
    for w in words:
        points += [*map(ord, w), 0]
    out = {}
    for size in (1, 2, 3):
        for i in range(len(points) - size + 1):
            gram = points[i : i + size]
            if not words or (size == 1 and gram[0] == 0):
                continue
            h = gram[0] * 0x9E3779B97F4A7C15 & M64
            for p in gram[1:]:
                h = (h * 0xD6E8FEB86659FD93 + p) & M64
            place = ((h ^ h >> 29) * 0xBF58476D1CE4E5B9 & M64) >> 52
            out[place] = out.get(place, 0) + 1
    return out, max(0, len(points) - 2)


def test_language_by_plain_loops(spark):
    rng = random.Random(5)
    own = {"aa": ["lorem", "ipsum", "dolor", "sit", "amet"], "bb": ["vägen", "går", "över", "ån", "nära"], "cc": ["река", "идёт", "под", "мостом"]}
    rows = [(lang, " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))) for lang, words in own.items() for _ in range(40)]
    df = spark.createDataFrame([*rows, *rows[:15], ("aa", None), (None, "nothing learned"), ("bb", "12 !")], "lang string, text string")
    model = language_id.fit(df)

    known = [(lang, text) for lang, text in [*rows, *rows[:15], ("bb", "12 !")]]
    seen = np.zeros(language_id.DIMENSIONS)
    for _, text in known:
        for place in gram_counts(text)[0]:
            seen[place] += 1
    assert model.idf == pytest.approx(np.log((len(known) + 1) / (seen + 1)) + 0.05, abs=1e-5)
    # each centroid is of unit length and of its own language's side of the space
    assert np.linalg.norm(model.centroids, axis=1) == pytest.approx(np.ones(len(model.languages)), abs=1e-5)

    texts = [t for _, t in rows[::3]] + [t for _, t, *_ in awkward() if t and len(t) < 3000] + ["lorem över под", "lorem1ipsum", "", "?!", "a"]
    found, score, rejected = model.predict(pa.array(texts, pa.large_string()))
    for text, lang, s, gone in zip(texts, found, score, rejected):
        counts, length = gram_counts(text)
        x = {p: math.log1p(n) * float(model.idf[p]) for p, n in counts.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        near = [sum(v * float(c[p]) for p, v in x.items()) / norm for c in model.centroids] if norm else []
        if not near:
            assert (lang, s, gone) == ("und", 0, True)
            continue
        best = max(near)
        assert s == pytest.approx(min(1, max(0, best)), abs=1e-5) and lang in {k for k, v in zip(model.languages, near) if v > best - 1e-5}
        least = model.least[max(i for i, low in enumerate(language_id.LENGTHS) if length >= low)]
        assert gone == (s < least) or abs(s - least) < 1e-6


def anchors_by_definition(text, k, s):
    """{hash: first place} of every k-mer whose least s-mer, by hash, stands at an edge; each k-mer is judged alone."""
    points = np.array([ord(c) + 1 for c in text], np.uint64)
    out = {}
    for i in range(len(text) - k + 1):
        inner = [int(mixed(run_hash(points[i + j : i + j + s].copy(), s), 11)[0]) for j in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.setdefault(int(mixed(run_hash(points[i : i + k].copy(), k), 12)[0]) >> 32, i)
    return out


def near_by_all(a, b, k, s):
    """Likeness over all anchors, nothing left out."""
    x, y = anchors_by_definition(a, k, s), anchors_by_definition(b, k, s)
    most = syncmers.SHIFT + max(len(a), len(b)) // syncmers.SHIFT_PART
    return sum(1 for h in x.keys() & y.keys() if abs(x[h] - y[h]) <= most) / max(1, len(x.keys() | y.keys()))


def test_syncmers_by_definition():
    rng = random.Random(8)
    texts = [prose(rng, n) for n in (12, 20, 40, 70)] + ["abc" * 60, "x" * 200, "日本語のテキスト " * 14, "short text", "tiny"]
    for text, found in zip(texts, syncmers.fingerprint(texts)):
        size, *own = found.split("-")
        size, _, small = size.partition("/")
        assert int(size, 16) == len(text)
        kinds = [(own, syncmers.K, syncmers.S), (small.split("."), syncmers.SHORT_K, syncmers.SHORT_S)] if len(text) >= syncmers.SHORT else [(own, syncmers.SHORT_K, syncmers.SHORT_S)]
        for held, k, s in kinds:
            want = anchors_by_definition(text, k, s)
            if want:
                assert held == [f"{h:08x}{want[h]:x}" for h in sorted(want)[: syncmers.SKETCH]]
            else:
                assert len(held) == 1


def test_error_of_the_sketch():
    """64 least anchors against all of them: the likeness of a sample of 64 has a standard error of sqrt(p (1 - p) / 64), 0.0625 at most."""
    rng, gaps = random.Random(13), []
    vocabulary = ["".join(rng.choice("abcdefghijklmnoprstuvy") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    for _ in range(24):
        a = " ".join(rng.choice(vocabulary) for _ in range(260))
        words = a.split()
        for _ in range(rng.choice([0, 2, 8, 25, 60])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        b = " ".join(words)
        fa, fb = syncmers.fingerprint([a, b])
        gaps.append(syncmers.likeness(fa, fb) - near_by_all(a, b, syncmers.K, syncmers.S))
    assert max(map(abs, gaps)) < 4 * 0.0625 and abs(sum(gaps) / len(gaps)) < 0.03 and math.sqrt(sum(g * g for g in gaps) / len(gaps)) < 0.0625


def readings(seen):
    """Every (word, cost of the channel) behind a word, all lattice paths."""
    choices = []
    for i, c in enumerate(seen):
        own = [(letter, toxicity.COST_LEET) for letter in toxicity.LEET.get(c, "")]
        if c.isalpha():
            own.append((c, toxicity.COST_SAME))
            if i and seen[i - 1] == c:
                own.append(("", toxicity.COST_DROP))
        else:
            own.append(("", toxicity.COST_SIGN))
        if c in toxicity.APART:
            own.append(("", toxicity.COST_APART))
        choices.append(own)
    for path in itertools.product(*choices):
        yield "".join(x for x, _ in path), sum(x for _, x in path)


def test_viterbi_against_all_readings(spark):
    rng = random.Random(21)
    docs = spark.createDataFrame([(prose(rng, 200),) for _ in range(20)], "text string").union(spark.range(1).select(F.lit(None).cast("string")))
    model = toxicity.character_model(docs)

    def cost(word, channel):
        at, total = (0, 0), channel
        for c in [*map(ord, word), 0]:
            total += model.cost(*at, c)
            at = (at[1], c)
        return total

    signs = "01345@$!|.-*~aeilorstn"
    words = ["r1v3r", "br|dg3", "w-i-n-t-e-r", "s.t.o.n.e", "soooong", "l1ght", "$0ng$", "1!|£", "aabb", "", "7", ".", "naïve", "8+8", "h0m3..", *("".join(rng.choice(signs) for _ in range(rng.randint(1, 8))) for _ in range(120))]
    for seen in words:
        best: dict[str, float] = {}
        for word, channel in readings(seen):
            total = cost(word, channel)
            best[word] = min(total, best.get(word, total))
        found = toxicity.decode(seen, model)
        assert best[found] <= min(best.values()) + 1e-9, seen
    assert [toxicity.decode(w, model) for w in words[:4]] == ["river", "bridge", "winter", "stone"]
