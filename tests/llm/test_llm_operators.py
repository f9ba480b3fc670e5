import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from llm_common import CLASHING, DDL, WORDS, awkward, clashing, prose, table
from pyspark.sql import functions as F

from tracewell.llm import exact_search, language_id, near_copies, packing, sentencepiece_bpe, sharding, simhash, substring_dedup, syncmers, toxicity
from tracewell.llm.components import components

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def test_sharding(spark):
    docs = clashing(table(spark)).withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)) + 8)
    found = sharding.shuffled(docs, "size", shards=5).collect()
    assert Counter(r["text"] for r in found) == Counter(r["text"] for r in docs.collect())
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert found[0]["bucket"] == "own bucket" and found[0]["row"] == "own row"
    assert sharding.shuffled(docs.limit(0), "size").collect() == []


def test_sharding_mixes_one_hot_key(spark):
    rows = spark.range(6000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"), F.col("id"), F.lit(12).alias("size"))
    found = sharding.shuffled(rows, "size", shards=8).orderBy("id").toPandas()
    assert abs(np.corrcoef(found["id"], found["shard"])[0, 1]) < 0.1 and abs(np.corrcoef(found["id"], found["slot"])[0, 1]) < 0.1


def test_packing(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(BPE)
    docs = clashing(table(spark))
    found = packing.pack(docs, BPE, capacity=128).collect()
    want = Counter()
    for _, text, *_ in awkward():
        ids = own.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) - (-(-len(ids) // 128) - 1) * 128
        cuts = [0, *range(first, len(ids) + 1, 128)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()), tuple(ids[a:b])] += 1
    assert Counter((r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in found) == want
    sequences = defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 128
    rooms = []  # no more sequences than best-fit, longest first, needs
    for length in sorted((r["length"] for r in found), reverse=True):
        fit = min((room for room in rooms if room >= length), default=None)
        rooms.append(128 - length if fit is None else rooms.pop(rooms.index(fit)) - length)
    assert len(sequences) <= len(rooms)
    assert packing.pack(docs.limit(0), BPE).collect() == []


def test_dominance_reduction_is_optimal_on_small_instances():
    rng = random.Random(4)

    def fewest(items, capacity):
        items, best = sorted(items, reverse=True), [len(items)]

        def place(i, rooms):
            if len(rooms) >= best[0]:
                return
            if i == len(items):
                best[0] = len(rooms)
                return
            for j in {r: j for j, r in enumerate(rooms) if r >= items[i]}.values():
                place(i + 1, rooms[:j] + [rooms[j] - items[i]] + rooms[j + 1 :])
            place(i + 1, rooms + [capacity - items[i]])

        place(0, [])
        return best[0]

    for _ in range(150):
        capacity = rng.randint(6, 20)
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 8))]
        left = np.zeros(capacity + 1, np.int64)
        for x in items:
            left[x] += 1
        plan = packing.Plan(capacity)
        packing.reduce_dominated(left, plan)
        rest = [x for x in range(capacity + 1) for _ in range(left[x])]
        assert all(sum(p) <= capacity for p, _ in plan.patterns)
        assert Counter(items) == Counter(rest) + Counter(x for p, n in plan.patterns for x in p for _ in range(n))
        assert plan.sequences + fewest(rest, capacity) == fewest(items, capacity)


def _labelled(rng, n):
    tongues = {"en": ["the", "of", "and", "house", "which", "through", "light"], "de": ["der", "die", "und", "haus", "welche", "durch", "licht"], "fr": ["le", "la", "et", "maison", "lequel", "lumière", "à"]}
    return [(prose(rng, rng.randint(5, 40), words), lang) for lang, words in tongues.items() for _ in range(n)]


def test_language_id(spark):
    rng = random.Random(2)
    train = spark.createDataFrame(_labelled(rng, 60) + [(None, "en"), ("text", None), ("", "en")], "text string, lang string")
    model = language_id.fit(train, sample=40)
    held = _labelled(rng, 20)
    languages, score, rejected = model.predict(pa.array([t for t, _ in held]))
    assert np.mean([a == b for a, (_, b) in zip(languages, held)]) > 0.97 and not rejected.any() and ((score >= 0) & (score <= 1)).all()
    assert model.predict(pa.array(["", "123 !!", "ЖЖЖЖЩЩЩЩ ЮЮЮЮФФФ ЭЭЭ ЪЪЪЪ ыыыы"]))[2].all()
    docs = clashing(table(spark))
    found = language_id.identify(docs, model).collect()
    assert Counter(r["text"] for r in found) == Counter(r["text"] for r in docs.collect())
    assert all(r["lang_pred"] == "und" and r["rejected"] for r in found if not any(c.isalpha() for c in r["text"] or ""))
    assert found[0]["copy"] == "own copy" and isinstance(found[0]["score"], float)
    assert language_id.identify(docs.limit(0), model).collect() == []
    empty = language_id.fit(train.limit(0))
    assert empty.predict(pa.array(["some text"]))[0] == ["und"]


def _kept(rows, window):
    """Brute force: identical rows are one document; equal ids go by the hash of the text."""
    docs = {}
    for doc_id, text, *_ in rows:
        copy = np.int64(np.uint64(xxhash.xxh64_intdigest((text or "").encode(), 42))) if text is not None else 42
        docs[(-(2**63) if doc_id is None else doc_id), int(copy), text] = WORDS.findall(text or "")
    seen, out = set(), {}
    for key in sorted(docs, key=lambda k: (k[0], k[1])):
        words, gone = docs[key], set()
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if w in seen:
                gone |= set(range(i, i + window))
            seen.add(w)
        out[key[0], key[2]] = (len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone))
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_substring_dedup(spark, monkeypatch, hot):
    rows = awkward()
    if hot:
        rng = random.Random(5)
        line = "a very common line that many documents share with each other"
        rows = rows + [(1000 + i, f"{prose(rng, 30)} {line} {prose(rng, 30)}", None, None, None) for i in range(60)]
        own = substring_dedup.hot_minimisers
        monkeypatch.setattr(substring_dedup, "HOT_SAMPLE", 1)
        found = own(spark.createDataFrame(rows, DDL).select("doc_id", F.xxhash64("text").alias("copy"), "text"), 200)
        assert found
        monkeypatch.setattr(substring_dedup, "hot_minimisers", lambda docs, partitions, window: found)
    docs = clashing(spark.createDataFrame(rows, DDL))
    got = substring_dedup.substring_dedup(docs).collect()
    want = _kept(rows, 20)
    own = lambda r: want[-(2**63) if r[0] is None else r[0], r[1]]
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got) == Counter((r[0], *own(r)) for r in rows)
    assert all(r["c0"] == "own c0" and r["found"] == "own found" for r in got)
    digests = {r["kept_sha256"] for r in substring_dedup.substring_dedup(docs, keep_text=False).collect()}
    assert digests == {hashlib.sha256(v[2].encode()).hexdigest() for v in want.values()}
    assert substring_dedup.substring_dedup(docs.limit(0)).collect() == []


def test_substring_dedup_tells_sequences_of_one_hash_apart(monkeypatch):
    monkeypatch.setattr(substring_dedup, "run_hash", lambda h, width: np.zeros_like(h))
    press = substring_dedup.zstandard.ZstdCompressor()
    texts = [b"a b c d", b"a b c e", b"a b c d"]
    blob = lambda i: press.compress(b"".join(x.tobytes() for x in [np.array([1, 1], np.int64), np.array([i], np.int64), np.array([i], np.int64), np.array([0], np.int32), np.array([0], np.int32), np.array([1], np.int32)]) + texts[i])
    found = substring_dedup._repeats_of([blob(0), blob(1), blob(2)], 4)
    assert found.column(0).to_pylist() == [2]


def test_syncmers(spark):
    rows = awkward()
    docs = clashing(table(spark))
    got = syncmers.fingerprints_and_edits(docs).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, int(np.int64(np.uint64(xxhash.xxh64_intdigest((r[1] or "").encode(), 42)))))
    ordered = sorted(rows, key=key)
    want = Counter()
    for (doc_id, text, *_), (_, after, *_) in zip(ordered, ordered[1:] + ordered[:1]):
        text, after = text or "", after or ""
        want[doc_id, len(text), hashlib.sha256(syncmers.edited(text, after).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    prints = dict(zip([r[1] or "" for r in rows], syncmers.fingerprint([r[1] or "" for r in rows])))
    assert {r["fingerprint"] for r in got} == set(prints.values()) and prints[""] == ""
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert np.median([r["near_edited"] for r in got if r["n_chars"] > 200]) > 0.4
    one = syncmers.fingerprints_and_edits(docs.where("doc_id = 3")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert syncmers.fingerprints_and_edits(docs.limit(0)).collect() == []


def test_syncmers_are_context_free():
    rng = random.Random(8)
    text = prose(rng, 200)
    a, b = syncmers.fingerprint([text, text[:300] + "CHANGED" + text[307:]])
    anchors = lambda f: {x for x in f.split("-")[1:]}
    limit = min(max(x[:8] for x in anchors(a)), max(x[:8] for x in anchors(b)))
    far = lambda f: {x for x in anchors(f) if x[:8] < limit and not 300 - syncmers.K <= int(x[8:], 16) <= 307}
    assert len(far(a) & far(b)) >= 0.9 * max(len(far(a)), len(far(b)))


def test_sentencepiece(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(3)
    parts = [" ", "  ", "a", "the", "▁", "\n", "\t", "é", "日本", "😀", "\x00", "aaaaaa", "    ", "=====", "0000", " " * 40, "привет", "<s>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(600)] + ["a" * 700, " " * 500, "ab " * 200]
    model = sentencepiece_bpe.Model(PIECES)
    ids, offsets = sentencepiece_bpe.with_ends(*model.encode(pa.array(texts)), model.bos, model.eos)
    decoded = model.decode(ids, offsets)
    for i, text in enumerate(texts):
        want = library.encode(text, add_bos=True, add_eos=True)
        assert ids[offsets[i] : offsets[i + 1]].tolist() == want and decoded[i].decode() == library.decode(want)
    docs = clashing(table(spark))
    for r in sentencepiece_bpe.encode_decode(docs, PIECES).collect():
        assert r["decoded"] == library.decode(r["ids"])
    assert sorted(tuple(r["ids"]) for r in sentencepiece_bpe.encode_decode(docs, PIECES).collect()) == sorted(tuple(library.encode(t or "", add_bos=True, add_eos=True)) for _, t, *_ in awkward())
    assert sentencepiece_bpe.encode_decode(docs.limit(0), PIECES).collect() == []
    broken = np.array([3 + 0xE6, 3 + 0x97], np.int64)
    assert model.decode(broken, np.array([0, 2])) == [library.decode(broken.tolist()).encode()]


def _toxic_rows(rng, n):
    bad = ["moron", "loser", "clown", "trash"]
    rows = []
    for i in range(n):
        words = prose(rng, 40).split()
        if i % 3 == 0:
            for _ in range(3):
                words[rng.randrange(40)] = rng.choice(bad)
        rows.append((" ".join(words), int(i % 3 == 0)))
    return rows


def test_toxicity(spark):
    rng = random.Random(6)
    labelled = spark.createDataFrame(_toxic_rows(rng, 240) + [(None, 1), ("", 0)], "text string, toxic int")
    model = toxicity.fit(labelled, labelled.select("text"))
    held = _toxic_rows(rng, 60)
    found = model.score(pa.array([t for t, _ in held])) >= toxicity.THRESHOLD
    assert (found == [y == 1 for _, y in held]).mean() > 0.97
    plain_text = prose(rng, 40)
    disguised = ["m0r0n", "l o s e r", "cl0wn", "trrrash", "m.o.r.o.n", "mooooron"]
    score = model.score(pa.array([f"{plain_text} {w} {plain_text}" for w in disguised] + [plain_text]))
    assert (score[:-1] > 4 * score[-1]).all()
    docs = clashing(table(spark))
    got = toxicity.score(docs, model).collect()
    assert Counter(r["text"] for r in got) == Counter(r["text"] for r in docs.collect())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= toxicity.THRESHOLD) and r["key"] == "own key" for r in got)
    assert toxicity.score(docs.limit(0), model).collect() == []
    nothing = toxicity.fit(labelled.limit(0), labelled.limit(0))
    assert len(nothing.score(pa.array(["text", ""]))) == 2


def test_deobfuscation_restores_words():
    words = ["loser", "people", "river", "the", "and", "moron"] * 5
    counts = Counter()
    for w in words:
        padded = "\0\0" + w + "\0"
        for a, b, c in zip(padded, padded[1:], padded[2:]):
            counts[ord(a) << 42 | ord(b) << 21 | ord(c)] += 1
    model = toxicity.CharacterModel(np.array(list(counts)), np.array(list(counts.values())))
    assert [toxicity.decode(x, model) for x in ("l0ser", "1oser", "m-o-r-o-n", "looooser", "m0r0n")] == ["loser", "loser", "moron", "loser", "moron"]


def test_exact_search(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    rows += [(300, rows[0][1]), (301, rows[0][1]), (302, None), (303, [1.0, None] + [0.0] * 6), (304, [float("nan")] * 8), (305, [float("inf")] * 8), (None, rows[1][1]), (350, [1.0, 2.0]), (351, [3.0, -1.0]), (352, [])]
    rows.append(rows[5])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"rank": F.lit("own"), "score": F.lit(1), "cell": F.lit(2), "kind": F.lit(3)})
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in exact_search.top_k(df, F.col("vec_id") % 50 == 0).collect()}
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = {}
    for q, a in good:
        if q % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(a) == len(b))[:5]
            want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(scores)}
    assert got == want
    assert exact_search.top_k(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


@pytest.mark.parametrize("size", [1e7, 1e12, 1e30, 1e160])
def test_exact_search_of_large_components(spark, size):
    rng = random.Random(int(size) % 97)
    base = [[rng.uniform(-size, size) for _ in range(3)] for _ in range(60)]
    base += [[x + 1 / 256 for x in base[i]] for i in range(20)] + [[3e5, 1.0, 0.0], [3e7, 1.0, 0.0], [float("inf"), 0.0, 0.0], [1e307, 0.0, 0.0]]
    rows = [(i, v) for i, v in enumerate(base)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = [tuple(r) for r in exact_search.top_k(docs, F.col("vec_id") % 5 == 0).collect()]
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows if np.isfinite(256 * np.array(v)).all()}
    held = lambda x: min(max(x, -(2**63)), 2**63 - 1)
    want = []
    for q in (i for i in whole if i % 5 == 0):
        best = sorted((-sum(x * y for x, y in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:5]
        want += [(q, rank, i, held(-score)) for rank, (score, i) in enumerate(best, 1)]
    if size < 1e15:
        assert sorted(found) == sorted(want)
    else:  # scores past 38 digits tie
        assert sorted((q, r, s) for q, r, _, s in found) == sorted((q, r, s) for q, r, _, s in want)


def test_exact_search_reads_few_vectors():
    rng = np.random.default_rng(1)
    x = rng.integers(-500, 500, (2000, 16))
    found = exact_search._Queries(np.arange(10), x[:10], 5)
    low = x.min(0).astype(float)
    step = (x.max(0) - low) / 255
    read = []
    own = found._take
    found._take = lambda part, rows, at, *rest: (read.append(len(rows)), own(part, rows, at, *rest))[1]
    found.scan(np.arange(2000), x, np.minimum((x - low) / step, 255).astype(np.uint8), low, step)
    assert sum(read) < 10 * 60


def _fingerprint(text):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORDS.findall(text or "")]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _groups(values, most):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= most:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(values))]


def test_simhash(spark):
    rows = awkward()
    docs = clashing(table(spark))
    got = simhash.simhash_components(docs).withColumn("hex", simhash.hex_fingerprint(F.col("fp"))).collect()
    values = [_fingerprint(t) for _, t, *_ in rows]
    groups = _groups(values, 3)
    least = {g: min((r[0] for r, h in zip(rows, groups) if h == g and r[0] is not None), default=None) for g in groups}
    assert Counter((r["doc_id"], r["hex"], r["component_id"]) for r in got) == Counter((r[0], f"{v:016x}", least[g]) for r, v, g in zip(rows, values, groups))
    assert simhash.simhash_components(docs.limit(0)).collect() == []


@pytest.mark.parametrize("hot_bucket", [20_000, 3])
def test_simhash_links_are_complete(spark, hot_bucket):
    rng = random.Random(9)
    centres = [rng.getrandbits(64) for _ in range(12)]
    values = list({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(25)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.close_links(spark.createDataFrame([(v,) for v in signed], "fp long"), hot_bucket)
    rows = links.collect()
    assert all(bin((r["a"] ^ r["b"]) & (2**64 - 1)).count("1") <= 3 for r in rows)
    roots = {r["node"]: r["root"] for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    groups = _groups(values, 3)
    by = defaultdict(set)
    for v, g in zip(signed, groups):
        by[g].add(roots.get(v, v))
    assert all(len(x) == 1 for x in by.values()) and len(set.union(*by.values())) == len(by)


def test_components(spark):
    rng = random.Random(10)
    chain = [(i, i + 1) for i in range(60)]
    star = [(100, i) for i in range(101, 160)]
    noise = [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(5, 5), (None, 3), (3, None), (100, 101)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain + star + noise, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in chain + star + noise:
        if a is not None and b is not None:
            root[max(find(a), find(b))] = min(find(a), find(b))
    assert all(find(x) == got.get(x, x) for x in root)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def _edits(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def test_near_copies(spark):
    rng = random.Random(11)
    vocabulary = [f"{a}{b}" for a in "bcdfghjklmnpqrstvwz" for b in ("a", "e", "i", "o", "un", "er", "ing")]
    base = [prose(rng, 200, vocabulary) for _ in range(40)]
    near = [(i, _edits(rng, base[i], 3)) for i in range(20) for _ in range(2)]
    loose = [_edits(rng, t, 60) for t in base[30:]]
    texts = base + [t for _, t in near] + loose + [base[0].upper(), None, "", "   "]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    docs = clashing(spark.createDataFrame(rows + [rows[3]], DDL))
    kept = sorted(r["doc_id"] for r in near_copies.drop_near_copies(docs).collect())
    assert kept == sorted([*range(40), *range(80, 90), 91])
    assert set(CLASHING) <= set(near_copies.drop_near_copies(docs).columns)
    assert near_copies.drop_near_copies(docs.limit(0)).collect() == []


def _shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def _jaccard(a, b):
    a, b = _shingles(a), _shingles(b)
    return len(a & b) / len(a | b)


def test_near_copies_by_one_contiguous_edit(spark):
    rng = random.Random(17)
    vocabulary = [f"{a}{b}{c}" for a in "bcdfghjklm" for b in ("a", "e", "i", "o") for c in ("n", "r", "st", "ck")]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    for count in (40, 400):
        texts = []
        for i in range(count):
            share, words = 0.78 + 0.09 * (i % 20) / 19, draw(200)
            kept, cut = round(196 * share) + 4, round(204 * (1 - share) / (1 + share)) - 4
            texts += [" ".join(words), " ".join([words + draw(round(196 / share) - 196), words[:kept], words[:60] + draw(cut) + words[60 + cut :]][i % 3])]
        near = [_jaccard(*texts[2 * i : 2 * i + 2]) for i in range(count)]
        assert sum(0.8 <= x < 0.88 for x in near) > count / 2 and min(near) < 0.8
        docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DDL)
        kept = sorted(r["doc_id"] for r in near_copies.drop_near_copies(docs).collect())
        assert kept == sorted([*range(0, 2 * count, 2), *(2 * i + 1 for i in range(count) if near[i] < 0.8)])


def _kept_by_brute_force(texts):
    root = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if root[i] != root[j] and _jaccard(texts[i], texts[j]) >= 0.8:
                root = [root[i] if r == root[j] else r for r in root]
    return sorted(min(i for i in range(len(texts)) if root[i] == r) for r in set(root))


@pytest.mark.parametrize("chunk", [near_copies.CHUNK, 7])
def test_near_copies_in_families_of_one_template(spark, monkeypatch, chunk):
    monkeypatch.setattr(near_copies, "CHUNK", chunk)
    rng = random.Random(18)
    texts = []
    for family in range(3):
        words = [f"w{family}x{i}" for i in range(150)]
        for _ in range(60):
            own = list(words)
            for at in rng.sample(range(0, 30), rng.randint(1, 4)):
                own[5 * at] = f"v{rng.randrange(6)}"
            texts.append(" ".join(own))
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DDL)
    want = _kept_by_brute_force(texts)
    assert 3 < len(want) < 150
    assert sorted(r["doc_id"] for r in near_copies.drop_near_copies(docs).collect()) == want


def test_pairs_of_a_near_group_grow_with_its_members(spark, monkeypatch):
    made, links = [], near_copies._links
    monkeypatch.setattr(near_copies, "_links", lambda texts, pairs, *more: (made.append(pairs.count()), links(texts, pairs, *more))[1])
    rng = random.Random(22)
    words = [f"w{i}" for i in range(200)]
    for count in (100, 400):
        texts = []
        for i in range(count):
            own = list(words)
            # two texts are linked if they have four edits together at most
            for at in rng.sample(range(40), 2 + i % 4):
                own[5 * at] = f"v{i}x{at}"
            texts.append(" ".join(own))
        docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DDL)
        made.clear()
        kept = sorted(r["doc_id"] for r in near_copies.drop_near_copies(docs).collect())
        assert kept == _kept_by_brute_force(texts) and 1 < len(kept) < count
        assert sum(made) < 8 * count


@pytest.mark.parametrize("whole", [None, 12])
def test_members_of_a_common_shingle_that_are_no_near_copies_go_no_further(spark, monkeypatch, whole):
    # no shingle is put last, so the passage's are met by many texts; the second time buckets over 12 members are not parted
    monkeypatch.setattr(near_copies, "COMMON", 10**9)
    if whole:
        monkeypatch.setattr(near_copies, "WHOLE", whole)
    rows, write = {"alive": 0}, near_copies.written

    def counted(df, name, *more):
        out = write(df, name, *more)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(near_copies, "written", counted)
    rng = random.Random(24)
    passage = [f"p{i}" for i in range(60)]
    for count in (40, 200):
        texts = [" ".join([f"w{i}x{j}" for j in range(100)] + passage) for i in range(count)]
        texts += [_edits(rng, texts[i % 3], 1 + i % 4) for i in range(count // 4)]
        rng.shuffle(texts)
        docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DDL)
        rows["alive"] = 0
        assert sorted(r["doc_id"] for r in near_copies.drop_near_copies(docs).collect()) == _kept_by_brute_force(texts)
        assert whole or rows["alive"] < 2 * len(texts)
        assert not whole or rows["alive"]


def test_parts_keep_the_pairs_that_may_be_similar():
    rng = np.random.default_rng(25)
    key = np.sort(rng.integers(0, 9, 300))
    n, pos = rng.integers(30, 3000, 300).astype(np.int32), rng.integers(0, 9, 300).astype(np.int32)
    part = near_copies._parts(key, n, pos, 0.8)
    x, y = np.triu_indices(300, 1)
    good = (key[x] == key[y]) & near_copies._similar(x, y, n, pos, 0.8)
    want = np.arange(300)
    for a, b in zip(x[good].tolist(), y[good].tolist()):
        want[want == max(want[a], want[b])] = min(want[a], want[b])
    assert part.tolist() == want.tolist() and 9 < len(set(want.tolist())) < 300


def test_sketches_of_long_sets():
    rng = np.random.default_rng(26)
    pool = rng.integers(0, 2**64, 14_000, dtype=np.uint64)
    sets = [np.unique(x) for x in (pool[:6000], pool[600:6600], pool[6600:12_600], pool[:1400])]
    cuts, n = np.cumsum([0, *map(len, sets)]), np.array([len(x) for x in sets], np.int32)
    bits = near_copies.sketches(np.concatenate(sets), cuts)
    more = [near_copies.sketches(x, np.array([0, len(x)]), near_copies.LONG_SKETCH).tobytes() if len(x) > near_copies.LONG else None for x in sets]
    near = near_copies._near(np.array([0, 0, 1]), np.array([1, 2, 2]), n, bits, np.array(more, object), 0.8)
    assert near.tolist() == [True, False, False]
    assert near_copies._near(np.array([3]), np.array([3]), n, bits, np.array(more, object), 0.8).all()


def test_sketches_differ_in_no_more_than_their_sets():
    rng = np.random.default_rng(23)
    for n in (0, 1, 30, 300, 5000):
        pool = rng.integers(0, 2**64, n + n // 5, dtype=np.uint64)
        both = [np.unique(rng.choice(pool, n, replace=False)) if n else pool for _ in range(2)]
        cuts = np.cumsum([0, *map(len, both)])
        x, y = near_copies.sketches(np.concatenate(both), cuts)
        differing, apart = int(np.bitwise_count(x ^ y).sum()), len(np.setxor1d(*both))
        assert differing <= apart and (n not in (30, 300) or differing > 0.8 * apart)


def test_near_copies_in_chains_of_edits(spark):
    rng = random.Random(19)
    texts = []
    for chain in range(12):
        words = [f"w{chain}x{i}" for i in range(120)]
        for step in range(30):
            words = list(words)
            for at in rng.sample(range(120), rng.randint(1, 3)):
                words[at] = f"c{chain}v{step}n{at}"
            texts.append(" ".join(words))
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DDL)
    want = _kept_by_brute_force(texts)
    assert len(want) < 200
    assert sorted(r["doc_id"] for r in near_copies.drop_near_copies(docs).collect()) == want


def test_near_copies_of_hot_texts_and_null_ids(spark):
    rows = [(i % 5 if i < 50 else i, "one two three four five six seven eight nine", None, None, None) for i in range(100)]
    rows += [(None, "a b c d e f", "x", None, None), (None, "A b c d e f", "y", None, None), (-(2**63), "a  b c d e f", "z", None, None)]
    docs = spark.createDataFrame(rows, DDL).withColumns({"__doc": F.lit("x"), "__copy": F.lit("x"), "__salt": F.lit("x"), "blob": F.lit("x")})
    found = near_copies.drop_near_copies(docs).collect()
    assert sorted((r["doc_id"], r["__doc"], r["__copy"], r["__salt"], r["blob"]) for r in found) == [(-(2**63), "x", "x", "x", "x"), (0, "x", "x", "x", "x")]


def test_near_copies_of_long_texts_at_the_threshold(spark):
    texts = []
    for i in range(60):
        words, share = [f"w{i}x{k}" for k in range(2004)], 0.79 if i % 2 else 0.802
        texts += [" ".join(words), " ".join(words[: round(2000 * share) + 4])]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DDL)
    kept = sorted(r["doc_id"] for r in near_copies.drop_near_copies(docs).collect())
    assert kept == sorted([*range(0, 120, 2), *range(3, 120, 4)])


def test_syncmers_of_repeated_passages():
    rng = random.Random(31)
    for passage, times in ((500, 10), (1500, 20), (3000, 60)):
        once = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(passage))
        a, b = syncmers.fingerprint([once + once[: syncmers.K], once * times])
        hashes = lambda f: [x[:8] for x in f.split("-")[1:]]
        assert len(hashes(b)) == syncmers.SKETCH and len(set(hashes(a)) & set(hashes(b))) >= syncmers.SKETCH - 3


def test_syncmers_across_the_short_edge(spark):
    rng = random.Random(32)
    draw = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    for longer in (97, 110, 127, 180):
        text = draw(longer)
        for shorter in (95, 80):
            a, b = syncmers.fingerprint([text, text[:shorter]])
            assert syncmers.likeness(a, b) == syncmers.likeness(b, a) > 0.75 * shorter / longer
        assert syncmers.likeness(*syncmers.fingerprint([text, draw(90)])) < 0.1
    found = syncmers.fingerprints_and_edits(spark.createDataFrame([(1, draw(100), None, None, None), (2, "", None, None, None)], DDL)).collect()
    assert {r["doc_id"]: r["near_edited"] for r in found}[1] > 0.5


def test_character_model_keeps_every_trigram(spark):
    rng = random.Random(33)
    words = ["".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(20)) for _ in range(11_000)]
    docs = spark.createDataFrame([(" ".join(words[i::20]),) for i in range(20)], "text string")
    model = toxicity.character_model(docs)
    assert model.all == sum(len(w) + 1 for w in words)
    floor = -np.log(1e-7)
    assert all(model.cost(ord(x), ord(y), ord(z)) < floor - 10 for w in words[:2000] for x, y, z in zip(w, w[1:], w[2:]))
