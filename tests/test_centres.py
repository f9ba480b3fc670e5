"""Centres by rounds against the plain rounds over whole groups, however the groups are cut."""

import math
import random

import numpy as np
import pytest

from tracewell.operators.centres import palette, two_means


def plain_two(values):
    v = np.array(sorted(values))
    low, high = v[0], v[-1]
    for _ in range(20):
        upper = v > (low + high) / 2
        low, high = (v[~upper].mean() if (~upper).any() else low), (v[upper].mean() if upper.any() else high)
    return (low + high) / 2, low, high, high >= 1.25 * max(low, 1e-9)


@pytest.mark.parametrize("share", [None, 7, 1])
def test_two_levels(spark, share):
    rng = random.Random(4)
    data = [(f"k{i % 9}" if i % 3 else "hot", i % 2, rng.choice([rng.gauss(2, 0.5), rng.gauss(9, 1), 4.0])) for i in range(700)]
    data += [(None, None, float(i % 5)) for i in range(40)] + [("one", 0, 3.5), ("same", 1, 2.0), ("same", 1, 2.0), ("none", 0, None), ("none", 0, float("nan")), ("some", 0, None), ("some", 0, 1.0), ("some", 0, 8.0), ("endless", 1, float("inf"))]
    df = spark.createDataFrame(data, "`a.b` string, v0 int, x double")
    got = {(r["a.b"], r["v0"]): tuple(r)[2:] for r in two_means(df, ["a.b", "v0"], "x", share=share).collect()}
    groups = {}
    for a, b, x in data:
        groups.setdefault((a, b), []).extend([x] if x is not None and math.isfinite(x) else [])
    assert set(got) == set(groups)
    for key, values in groups.items():
        assert got[key] == (pytest.approx(plain_two(values)) if values else (None, None, None, False)), key
    assert two_means(df.limit(0), ["a.b", "v0"], "x").collect() == []


@pytest.mark.parametrize("share", [None, 40])
def test_palettes(spark, share):
    rng = random.Random(6)
    spots = [(20, 5, 5), (60, -30, 10), (80, 40, 60), (50, 0, -50)]
    data = [("hot" if i % 2 else f"g{i % 6}", [round(c + rng.gauss(0, 3), 1) for c in rng.choice(spots)]) for i in range(2400)] + [("few", [1.0, 2.0, 3.0])] * 199 + [("flat", [5.0, 5.0, 5.0])] * 200 + [("hot", None), ("hot", [1.0, None, 2.0]), ("hot", []), ("hot", [4.0])]
    got = {r.g: r for r in palette(spark.createDataFrame(data, "g string, c array<double>"), ["g"], "c", share=share).collect()}
    assert set(got) == {g for g, _ in data}
    for g, r in got.items():
        x = np.array(sorted(c for k, c in data if k == g and c and None not in c and len(c) == 3))
        if len(x) < 200:
            assert r.colours is None and r.chroma_at is None and r.diversity is None
            continue
        centre = x[np.linspace(0, len(x) - 1, 5).astype(int)]
        for _ in range(15):
            near = ((x[:, None] - centre[None]) ** 2).sum(-1).argmin(1)
            centre = np.stack([x[near == i].mean(0) if (near == i).any() else centre[i] for i in range(5)])
        share_of = np.bincount(near, minlength=5) / len(x)
        order = np.argsort(-share_of, kind="stable")
        assert [c.share for c in r.colours] == pytest.approx(share_of[order].tolist())
        assert np.array([c.lab for c in r.colours]) == pytest.approx(centre[order])
        assert r.chroma_at == int(np.argmax(np.where(share_of[order] > 0.05, np.hypot(*centre[order].T[1:]), -1)))
        some = share_of[share_of > 0]
        assert r.diversity == pytest.approx(float(-(some * np.log(some)).sum()))
