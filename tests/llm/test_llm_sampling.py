"""Samples of labelled texts, and what classifiers learn from labels whose texts repeat."""

from collections import Counter

import pytest
from llm_common import prose
from pyspark.sql import functions as F
import random

from tracewell.llm import language_id, near_copies, sampling, toxicity


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_bounded(spark, broadcast, monkeypatch):
    monkeypatch.setattr(sampling, "_BROADCAST", broadcast)
    rows = [("many", f"text {i}") for i in range(900)] + [("few", f"text {i % 5}") for i in range(900)] + [("one", None), ("one", "x"), (None, "y")]
    found = [tuple(r) for r in sampling.bounded(spark.createDataFrame(rows, "lang string, text string").repartition(7), "lang", 40).collect()]
    assert len(set(found)) == len(found) and set(found) <= set(rows)
    assert Counter(x for x, _ in found) == {"many": 40, "few": 5, "one": 2}
    again = sampling.bounded(spark.createDataFrame(rows[::-1], "lang string, text string").repartition(3), "lang", 40).collect()
    assert {tuple(r) for r in again} == set(found)
    assert sampling.bounded(spark.createDataFrame([], "lang string, text string"), "lang", 40).collect() == []


def test_too_many_labels(spark, monkeypatch):
    monkeypatch.setattr(sampling, "LABELS", 3)
    with pytest.raises(ValueError):
        sampling.bounded(spark.range(4).selectExpr("id as lang", "'a' as text"), "lang", 1)


def test_labels_whose_texts_repeat_are_learned(spark):
    rng = random.Random(1)
    rows = [("aa", prose(rng, 20)) for _ in range(600)] + [("bb", " ".join(rng.choice(["zug", "wohl", "kraft", "juwel"]) for _ in range(20))) for _ in range(5)] * 4000
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert set(language_id.fit(docs).languages) == {"aa", "bb"}
    rude = [prose(rng, 20) + " you utter worthless fool" for _ in range(3)] * 5000
    known = spark.createDataFrame([(prose(rng, 20), 0) for _ in range(300)] + [(t, 1) for t in rude], "text string, toxic int")
    scored = toxicity.score(spark.createDataFrame([(rude[0],), (prose(rng, 20),)], "text string"), toxicity.fit(known, known)).collect()
    by = {r["text"]: r["score"] for r in scored}
    assert by[rude[0]] > 0.3 > min(by.values())


def test_texts_of_one_64_bit_hash_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "_identity", lambda text: [F.lit(1).cast("long").alias("h"), F.xxhash64(text).alias("h2")])
    rng = random.Random(2)
    texts = [prose(rng, 40) for _ in range(6)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near_copies.drop_near_copies(docs).collect()) == list(range(6))
