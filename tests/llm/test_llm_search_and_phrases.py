"""Lexical search, collocations and decontamination against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm_common import awkward, clashing, prose, table
from pyspark.sql import functions as F

from tracewell.llm import collocations, decontamination, lexical_search
from tracewell.llm.filters import bit_filter, may_hold

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEM_DDL = "item_id long, text string, score string, query_row string"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def terms(text):
    return TERM.findall(low(text))


def test_bit_filter(spark):
    rng = np.random.default_rng(1)
    h = rng.integers(-(2**63), 2**63 - 1, 3000)
    words = bit_filter(spark.createDataFrame([(int(x),) for x in h], "h long"), "h", 3000)
    assert may_hold(words, h).all() and may_hold(words, rng.integers(-(2**63), 2**63 - 1, 3000)).mean() < 0.1
    assert not may_hold(bit_filter(spark.createDataFrame([], "h long"), "h", 0), h).any()


# --- decontamination


def contaminated(rows, items, window=10):
    found = []
    for text in rows:
        words, hit, ids = terms(text), set(), set()
        for item_id, item in items:
            own = terms(item)
            n = min(len(own), window)
            windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
            at = [i for i in range(len(words) - n + 1) if n and tuple(words[i : i + n]) in windows]
            hit |= {i + j for i in at for j in range(n)}
            if at and item_id is not None:
                ids.add(item_id)
        found.append((len(words), len(hit), tuple(sorted(ids)), tuple(sorted(hit))))
    return found


def items_and_texts(seed=3):
    rng = random.Random(seed)
    items = [(i, prose(rng, rng.randint(12, 40))) for i in range(12)]
    items += [(20, "one Two three"), (21, "naïve"), (22, None), (23, " .,;"), (24, items[0][1]), (24, items[1][1]), (None, prose(rng, 15)), (25, "x " * 14), (26, "river " * 4 + "stone " * 12), (27, items[2][1].upper())]
    cut = [i[1].split(" ") for i in items[:8]]
    texts = [t for _, t, *_ in awkward()]
    texts += [prose(rng, 20) + " " + " ".join(cut[0][1:12]) + "; " + prose(rng, 5), " ".join(cut[1][:9]), " ".join(cut[1][:10]), "\n".join(cut[2]) + " " + " ".join(cut[3]), "ONE, two -- three!", "x " * 40, "river " * 9 + "stone " * 20, items[-4][1]]
    texts += [f"{k} " + items[5][1] for k in range(60)]  # one passage in most documents
    return items, texts


def test_decontamination(spark):
    items, texts = items_and_texts()
    docs = clashing(spark.createDataFrame([(i if i % 7 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")).withColumn("at", F.monotonically_increasing_id()).withColumn("spans", F.lit(1))
    found = decontamination.decontaminate(docs.coalesce(1).withColumn("at", F.monotonically_increasing_id()), spark.createDataFrame([(*x, "a", "b") for x in items], ITEM_DDL)).orderBy("at").collect()
    want = contaminated(texts, items)
    assert [r["text"] for r in found] == texts and found[0]["n_words"] is not None and found[0]["rank"] == "own rank"
    for r, (n, n_hit, ids, hit) in zip(found, want):
        assert (r["n_words"], r["n_hit"], tuple(sorted(r["items"])), r["contaminated"]) == (n, n_hit, ids, n_hit > 0)
        assert sorted(i for s in r["spans"] for i in range(s["start"], s["end"])) == list(hit)
        assert all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))


def test_decontamination_of_empty_tables(spark):
    items, texts = items_and_texts()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    some = spark.createDataFrame([(*x, "a", "b") for x in items], ITEM_DDL)
    assert decontamination.decontaminate(docs.limit(0), some).collect() == []
    clean = decontamination.decontaminate(docs, some.limit(0), keep_text=False).collect()
    assert len(clean) == len(texts) and not any(r["n_hit"] or r["items"] or r["contaminated"] for r in clean) and "text" not in clean[0].asDict()


def test_every_long_shared_span_has_a_common_fingerprint():
    rng = np.random.default_rng(5)
    for length in (1, 2, 3, 7, 10):
        span = rng.integers(0, 2**63, 40).astype(np.uint64)
        one = np.concatenate([rng.integers(0, 2**63, 9).astype(np.uint64), span, rng.integers(0, 2**63, 9).astype(np.uint64)])
        other = np.concatenate([span, rng.integers(0, 2**63, 20).astype(np.uint64)])
        assert (decontamination.winnowed(one, length)[9 : 49 - length + 1] == decontamination.winnowed(other, length)[: 40 - length + 1]).all()


# --- collocations


def best_phrases(rows, most_words, least, covered, first):
    n, f = Counter(), Counter()
    for group, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[group or "und"] += len(words)
            for k in range(1, most_words + 1):
                f.update((group or "und", tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    out = defaultdict(list)
    candidates = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    for (group, words), a in candidates.items():
        score, cut = min((10**6 * a * a // (f[group, words[:k]] * f[group, words[k:]]), k) for k in range(1, len(words)))
        longer = [b for (g, w), b in candidates.items() if g == group and len(w) > len(words) and any(w[i : i + len(words)] == words for i in range(len(w)))]
        if not any(100 * b >= covered * a for b in longer):
            out[group].append((-score, -a, " ".join(words).encode(), f[group, words[:cut]], f[group, words[cut:]], cut))
    return {(g, r, p.decode(), -a, x, y, n[g], -s, cut) for g, all_ in out.items() for r, (s, a, p, x, y, cut) in enumerate(sorted(all_)[:first], 1)}


@pytest.mark.parametrize("most_words", [2, 3, 5])
def test_collocations(spark, most_words):
    rng = random.Random(8)
    rows = [(g, prose(rng, rng.randint(1, 40)).replace(",", rng.choice([",", ";", "\n", "!", "\t"]))) for _ in range(60) for g in ("en", "de", None, "und")]
    rows += [("en", t) for _, t, *_ in awkward()] + [(None, None), ("fr", None), ("fr", ""), ("es", "New York City New York")] + [("hot", "Under the Stone bridges. under the")] * 300
    docs = spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit("own") for c in ("group", "phrase", "n", "h", "rank", "left")})
    found = collocations.collocations(docs, most_words=most_words, least=4, first=25).collect()
    got = {(r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"], r["cut"]) for r in found}
    assert len(got) == len(found) and got == best_phrases(rows, most_words, 4, 50, 25)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(table(spark).limit(0)).collect() == []
    assert collocations.collocations(table(spark, [(1, "too few words", "en", "s", 1)])).collect() == []


# --- lexical search


def ranked(rows, items, k):
    docs = [(i, Counter(terms(t))) for i, t in rows]
    held = [sum(c.values()) for _, c in docs]
    N, L = sum(n > 0 for n in held), sum(held)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for (doc_id, c), n in zip(docs, held):
            m = 10 + 90 * n * N // L
            score = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if score:
                scores.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize("documents,most", [(3, 1 << 22), (128, 60)])
def test_lexical_search(spark, documents, most, monkeypatch):
    monkeypatch.setattr(lexical_search, "BATCH", most)
    rng = random.Random(2)
    vocabulary = [f"w{int(rng.paretovariate(0.4))}" for _ in range(400)]
    rows = [(i, t) for i, t, *_ in awkward()] + [(100 + i, prose(rng, rng.randint(1, 60), vocabulary)) for i in range(300)] + [(None, "w1 w2"), (5, "w1 w2"), (5, "w1 w2")] + [(500 + i, "w1 copy") for i in range(40)]
    items = [(i, prose(rng, rng.randint(1, 12), vocabulary)) for i in range(30)] + [(40, None), (41, " "), (42, "unseen"), (43, "River, THE naïve"), (43, "w1 W2 w2"), (None, "w1"), (44, "copy w1"), (45, " ".join(f"w{i}" for i in range(300)))]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    found = lexical_search.search(lexical_search.build_index(docs, documents_of_block=documents), spark.createDataFrame([(*x, "a", "b") for x in items], ITEM_DDL), k=7)
    assert Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found.collect()) == ranked(rows, items, 7)


def test_lexical_search_of_empty_tables(spark):
    docs, items = table(spark), spark.createDataFrame([(1, "river", "a", "b")], ITEM_DDL)
    assert lexical_search.search(lexical_search.build_index(docs.limit(0)), items).collect() == []
    assert lexical_search.search(lexical_search.build_index(docs), items.limit(0)).collect() == []


def test_blocks_under_the_threshold_are_not_opened():
    def block(*texts):
        ids = range(len(texts))
        return lexical_search._block(pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts)], ["doc_id", "text"]), 100, 1000)

    good, poor = block("winter light", "winter light songs"), block("winter", "stone bridges")
    batches = [pa.RecordBatch.from_arrays([pa.array([s], pa.binary()), pa.array([f], pa.binary())], ["summary", "forward"]) for s, f in (good, (poor[0], b"not to be opened"))]
    weights, n = np.array([[100.0], [100.0]]), np.zeros(1, np.int64)
    run = lexical_search._scored(["winter", "light"], weights, n, n + 2**62, n, 2)
    (best,) = run(iter(batches[:1]))
    reached = np.array([min(best.column(1).to_pylist())])
    run = lexical_search._scored(["winter", "light"], weights, n, n + 2**62, reached, 2)
    assert [b.column(2).to_pylist() for b in run(iter(batches))] == [best.column(2).to_pylist()]


def test_scores_past_the_whole_numbers_of_doubles():
    batch = lexical_search.Batch()
    batch.add(0, [f"t{i}" for i in range(400_000)])
    assert batch.weights(np.ones(400_000, np.int64), 10**12).dtype == np.int64
    batch = lexical_search.Batch()
    batch.add(0, ["t"])
    assert batch.weights(np.ones(1, np.int64), 10**12).dtype == float
