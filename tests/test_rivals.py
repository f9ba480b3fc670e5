"""Cosines to rivals with awkward keys and vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators.joins import rival_similarity, rivals_by_vector


def cosine(a, b):
    return float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))


def test_rivals(spark):
    rng = np.random.default_rng(4)
    vec = lambda n: rng.normal(size=n).tolist()
    rows = [(g, s, i, vec(3)) for g in (1, None) for s in ("x", "y", None) for i in range(5)] + [(1, "x", 90, vec(4)), (1, "x", 91, None), (1, "x", 92, []), (2, "x", 93, vec(3))]
    centres = [(g, s, vec(3)) for g in (1, None) for s in ("x", "y", "z")] + [(1, "w", vec(4)), (None, "v", None)]
    df = spark.createDataFrame(rows, "g long, s string, i long, v array<double>").withColumns({"part": F.lit("own"), "__part": F.lit(1), "parts": F.lit(2), "cos_self": F.lit("old")})
    found = rival_similarity(df, spark.createDataFrame(centres, "g long, s string, c array<double>"), ["g"], "s", "v", "c", share=4).collect()
    assert len(found) == len(rows) and {r["part"] for r in found} == {"own"} and found[0]["parts"] == 2
    for r in found:
        near = {s: cosine(r["v"], c) for g, s, c in centres if g == r["g"] and c and r["v"] and len(c) == len(r["v"])}
        others = [x for s, x in near.items() if s != r["s"]]
        assert r["cos_self"] is None if r["s"] not in near else abs(r["cos_self"] - near[r["s"]]) < 1e-12
        assert r["cos_other"] is None if not others else abs(r["cos_other"] - max(others)) < 1e-12


@pytest.mark.parametrize("cells,parts,listed", [(1, None, False), (3, 5, True)])
def test_rivals_by_vector(spark, cells, parts, listed):
    rng = np.random.default_rng(5)
    vec = lambda n: rng.normal(size=n).astype(np.float32).tolist()
    vectors = [(i, vec(3)) for i in range(9)] + [(i, vec(3)) for i in (2, 2, 5)] + [(9, vec(4)), (5, vec(4)), (10, None), (11, [0.0, 0.0, 0.0]), (None, vec(3))]
    rows = [(g, s, a) for g in (1, 2, 3, None) for s in ("x", "y", "z", None) for a in (*range(13), None)]
    centres = [(g, s, vec(3)) for g in (1, None) for s in ("x", "y", "z")] + [(1, "w", vec(4)), (None, "v", None), (2, "x", vec(3))]
    df = spark.createDataFrame(rows, "g long, s string, a int").withColumns({"more": F.lit("own"), "cos_self": F.lit("old")})
    table, held = spark.createDataFrame(vectors, "a long, v array<float>"), spark.createDataFrame(centres, "g long, s string, c array<double>")
    out = rivals_by_vector(df, table, held, ["g"], "s", "a", "v", "c", cells, parts, df.select("g") if listed else None)
    assert out.columns == ["g", "s", "more", "cos_self", "cos_other"]
    with np.errstate(invalid="ignore"):
        near = lambda g, a: [(s, cosine(v, c)) for i, v in vectors if i == a and v and a is not None for h, s, c in centres if h == g and c and len(c) == len(v)]
        want = [(g, s, max_of([x for t, x in near(g, a) if t == s]), max_of([x for t, x in near(g, a) if t != s])) for g, s, a in rows]
    plain = lambda x: "none" if x is not None and x != x else None if x is None else round(x, 9)
    assert sorted(((r["g"], r["s"], plain(r["cos_self"]), plain(r["cos_other"])) for r in out.collect()), key=repr) == sorted(((g, s, plain(x), plain(y)) for g, s, x, y in want), key=repr)


def max_of(found):
    """As SQL has it: none of nothing, and no number above all."""
    return None if not found else float("nan") if any(x != x for x in found) else max(found)
