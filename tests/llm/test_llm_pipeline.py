import random

import pytest
from llm_common import DDL, awkward, clashing, prose
from pyspark.sql import functions as F

import corpus_pipeline
from tracewell.llm import queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    vocabulary = {"en": ["the", "river", "stone", "which", "through"], "de": ["der", "fluss", "stein", "welcher", "durch"]}
    names = {lang: [w + end for w in words for end in ("", "ka", "mo", "til", "ra", "vek", "sul", "nop")] for lang, words in vocabulary.items()}
    rows, labels = [], []
    for i in range(120):
        lang = "en" if i % 2 else "de"
        words = prose(rng, 60, names[lang]).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(4):
                words[rng.randrange(60)] = rng.choice(["moron", "loser"])
        rows.append((i, " ".join(words), lang, "src", None))
        labels.append((i, 1, int(toxic)))
    rows += [(200, rows[1][1], "en", "src", None), (201, None, None, None, None), (202, "12 34 !!", None, None, None)]
    rows += [(doc_id + 1000 if doc_id is not None else None, text, None, source, None) for doc_id, text, _, source, _ in awkward() if text is not None]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, DDL).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, rows = docs.columns, docs.collect()
    by_id = {r["doc_id"]: r for r in rows}
    toxic, language, near, repeats, packed = [f for _, f in corpus_pipeline.STAGES]
    kept = toxic(spark, docs, folder).collect()
    ids = [r["doc_id"] for r in kept]
    assert sum(i in ids for i in range(0, 120, 5)) <= 2 and sum(i in ids for i in range(120) if i % 5) >= 92
    assert all(by_id[r["doc_id"]] == r or r["doc_id"] in (None, 1007, 1002) for r in kept)
    known = [r["doc_id"] for r in language(spark, docs, folder).collect()]
    assert 201 not in known and 202 not in known and set(range(120)) <= set(known)
    single = near(spark, docs, folder)
    assert single.columns == columns
    texts = [r["text"] for r in single.collect() if r["text"]]
    assert len(texts) == len(set(texts)) and 200 not in [r["doc_id"] for r in single.collect()]
    trimmed = repeats(spark, docs, folder)
    assert trimmed.columns == columns and trimmed.where("doc_id = 200").first()["text"] == ""
    assert all(r["n_chars"] == len(r["text"]) for r in trimmed.collect())
    for f in (toxic, language, near, repeats, packed):
        assert f(spark, docs.limit(0), folder).collect() == []
        extra = f(spark, clashing(docs.limit(20)), folder)
        extra.collect()


def test_run(spark, folder):
    found = corpus_pipeline.run(spark, folder)
    assert found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and found.count() > 80


def test_queries_have_their_columns(spark, folder):
    spark.createDataFrame([(i, [float(i % 7), float(i % 3)]) for i in range(120)], "vec_id long, embedding array<float>").write.mode("overwrite").parquet(f"{folder}/embeddings.parquet")
    contract = {
        "op1_sharding": "doc_id size text_crc32 law shard slot grown_shard",
        "op2_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset",
        "op3_language_id": "doc_id held_out lang_pred score",
        "op4_substring_dedup": "doc_id n_words n_removed kept_sha256",
        "op5_syncmer_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
        "op6_sentencepiece": "doc_id n_tokens ids_sha256 decoded_sha256",
        "op8_toxicity": "doc_id held_out score predicted",
        "op9_exact_top_k": "query_id rank vec_id score",
        "op10_simhash_near_dedup": "doc_id fingerprint component_id",
    }
    kinds = {"size": "bigint", "shard": "int", "slot": "bigint", "grown_shard": "int", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint", "held_out": "boolean", "rank": "int", "predicted": "int", "text_crc32": "bigint", "n_words": "bigint", "n_removed": "bigint", "n_chars": "bigint", "n_tokens": "bigint"}
    for name, columns in contract.items():
        found = queries.QUERIES[name](spark, folder)
        assert found.columns[: len(columns.split())] == columns.split()
        types = dict(found.dtypes)
        assert all(types[c] == k for c, k in kinds.items() if c in types), name
        if name != "op9_exact_top_k":
            assert found.select(F.count_distinct("doc_id")).first()[0] == spark.read.parquet(f"{folder}/documents.parquet").select(F.count_distinct("doc_id")).first()[0]


def test_sharding_writes_the_texts(spark, folder, monkeypatch):
    paths = []
    write = queries.write_shards
    monkeypatch.setattr(queries, "write_shards", lambda sharded, path: (paths.append(path), write(sharded, path)))
    found = queries.op1_sharding(spark, folder).collect()
    shards = spark.read.parquet(paths[0])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(shards.select("doc_id", "text").collect(), key=key) == sorted(docs.select("doc_id", "text").collect(), key=key)
    want = shards.select("doc_id", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")), "shard", "slot").collect()
    assert sorted(want, key=key) == sorted([(r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in found], key=key)
