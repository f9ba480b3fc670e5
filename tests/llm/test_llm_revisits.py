import random

import pytest
from llm_common import clashing
from pyspark.sql import functions as F

from tracewell.llm import revisits

DDL = "record_id long, url string, fetched long, kind string, headers map<string,string>"


@pytest.mark.parametrize(
    "url, want",
    [
        ("HTTP://WWW.Example.com:80/a/b/?utm_source=x&b=2&a=1#top", "example.com/a/b?a=1&b=2"),
        ("https://example.com", "example.com"),
        ("https://example.com/?ref=x", "example.com"),
        ("example.com/A/", "example.com/A"),
        (None, None),
        ("", ""),
    ],
)
def test_canonical_url(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(revisits.canonical_url(F.col("u"))).first()[0] == want


def test_resolution(spark):
    h = lambda **k: {a.replace("_", "-"): b for a, b in k.items()}
    rows = [
        (1, "http://a.com/x", 10, "response", h(etag='"1"', content_type="text/html", date="d1", server="s")),
        (2, "https://www.a.com/x/#f", 20, "revisit", h(etag='W/"1"', content_type="other", date="d2")),
        (3, "http://a.com/x", 30, "response", h(etag='"2"', last_modified="m")),
        (4, "http://a.com/x", 40, "revisit", h(etag='"1"')),
        (5, "http://a.com/x", 50, "revisit", h(last_modified="m")),
        (6, "http://a.com/x", 60, "revisit", h(date="d")),
        (7, "http://a.com/x", 5, "revisit", h(etag='"1"')),
        (8, "http://b.com", 9, "revisit", None),
        (9, None, 9, "revisit", h(etag="x")),
        (10, "http://a.com/x", 30, "revisit", h(etag='"2"')),
        (11, "http://a.com/x", None, "revisit", h(etag='"2"')),
        (12, "http://a.com/x", 70, "metadata", None),
    ]
    docs = clashing(spark.createDataFrame(rows + [rows[1]], DDL))
    found = revisits.resolve(docs).collect()
    by = {r["record_id"]: r for r in found}
    assert len(found) == 10
    assert {k: (r["resolved_id"], r["status"]) for k, r in by.items()} == {
        2: (1, "resolved"), 4: (None, "validator mismatch"), 5: (3, "resolved"), 6: (None, "no validator"), 7: (None, "no earlier response"),
        8: (None, "no earlier response"), 9: (None, "no url"), 10: (None, "validator mismatch"), 11: (None, "no earlier response"),
    }
    assert by[2]["headers"] == {"etag": 'W/"1"', "content-type": "text/html", "date": "d2", "server": "s"}
    assert revisits.resolve(docs.limit(0)).collect() == []


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, f"http://h{rng.choice([0, 0, 0, 1, 2])}.com/p", 10**15 if i == 9 else -(10**12) if i == 3 else rng.randrange(400), rng.choice(["response", "revisit"]), {"etag": str(rng.randrange(3))}) for i in range(500)]
    got = {r["record_id"]: (r["resolved_id"], r["status"]) for r in revisits.resolve(spark.createDataFrame(rows, DDL)).collect()}
    for i, url, at, kind, headers in rows:
        if kind == "revisit":
            stored = max(((t, j, h) for j, u, t, k, h in rows if k == "response" and u == url and t < at), key=lambda x: x[:2], default=None)
            want = (None, "no earlier response") if stored is None else (stored[1], "resolved") if stored[2] == headers else (None, "validator mismatch")
            assert got[i] == want
