"""Pictures of several shapes, meshes and frames by ordinal, with rows that cannot be read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.functions.pixels import picture_stats, surface_stats, vertex_normals
from tracewell.sources.tables import frames_by_ordinal

PICTURE = "i int, p array<double>, w array<double>, h int, n int"


def mirrored(k, n):
    return -k if k < 0 else 2 * (n - 1) - k if k >= n else k


def laplacian(p):
    h, w = p.shape
    at = lambda y, x: p[mirrored(y, h), mirrored(x, w)]
    return np.array([[at(y - 1, x) + at(y + 1, x) + at(y, x - 1) + at(y, x + 1) - 4 * p[y, x] for x in range(w)] for y in range(h)])


def test_pictures_of_several_shapes(spark):
    rng = np.random.default_rng(3)
    shapes = [(8, 8), (3, 3), (5, 9), (8, 8), (11, 7)]
    pictures = [rng.integers(0, 256, s).astype(float) for s in shapes]
    rows = [(i, p.ravel().tolist(), [1.0] * p.size, *p.shape) for i, p in enumerate(pictures)]
    flat = [100.0] * 64
    bad = [(90, None, None, 8, 8), (91, [1.0] * 63, [1.0] * 63, 8, 8), (92, [None] * 9, [1.0] * 9, 3, 3), (93, [float("nan")] * 9, [1.0] * 9, 3, 3), (94, [], [], 0, 0), (95, [1.0] * 4, [1.0] * 4, 2, 2), (96, [1.0] * 9, [1.0] * 9, None, 3)]
    df = spark.createDataFrame([*rows, *bad, (80, flat, [1.0] * 64, 8, 8), (81, flat, [0.0] * 64, 8, 8)], PICTURE)
    got = {r.i: r for r in df.select("i", picture_stats(F.col("p"), F.col("h"), F.col("n")).alias("r"), surface_stats(F.col("p"), F.col("w"), F.col("h"), F.col("n")).alias("s")).collect()}
    assert len(got) == len(rows) + len(bad) + 2
    for i, p in enumerate(pictures):
        r = got[i].r
        assert r.blur == pytest.approx(laplacian(p).var()) and r.exposure == pytest.approx(p.mean() / 255) and r.contrast == pytest.approx(p.std() / 255)
        assert (r.clipped, r.crushed) == pytest.approx(((p >= 250).mean(), (p <= 5).mean()))
        h, w = p.shape
        assert r.sectors == pytest.approx([p[a * h // 3 : (a + 1) * h // 3, b * w // 3 : (b + 1) * w // 3].mean() / 255 for a in range(3) for b in range(3)])
        if p.size >= 50:
            shares = np.unique(p, return_counts=True)[1] / p.size
            assert got[i].s.entropy == pytest.approx(-(shares * np.log2(shares)).sum()) and got[i].s.lum == pytest.approx(p.mean())
        else:
            assert tuple(got[i].s) == (None,) * 6
    for i, *_ in bad:
        assert set(got[i].r) == {None} and set(got[i].s) == {None}
    assert (got[80].r.blur, got[80].r.light_lr, got[80].r.light_harsh, got[80].s.entropy, got[80].s.contrast) == (0, 0, 0, 0, 0)
    assert got[81].r.exposure == pytest.approx(100 / 255) and set(got[81].s) == {None}  # no pixel has weight


def test_light_is_read_by_side(spark):
    left = np.tile([200.0] * 4 + [50.0] * 4, 8)
    top = np.repeat([200.0] * 4 + [50.0] * 4, 8)
    df = spark.createDataFrame([(0, left.tolist(), None, 8, 8), (1, top.tolist(), None, 8, 8)], PICTURE)
    a, b = (r.r for r in df.orderBy("i").select(picture_stats(F.col("p"), F.col("h"), F.col("n")).alias("r")).collect())
    assert a.light_lr > 0.45 and abs(a.light_tb) < 1e-9 and b.light_tb > 0.45 and abs(b.light_lr) < 1e-9


def test_normals(spark):
    square = [0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 1.0, 0.0]
    rows = [(0, square), (1, square[3:] + square[:3]), (2, [0.0] * 12), (3, None), (4, square[:-1]), (5, square[:6]), (6, square + [9.0] * 3), (7, [])]
    fan = vertex_normals([(0, 2, 1), (0, 3, 2)])
    got = {r.i: r.n for r in spark.createDataFrame(rows, "i int, v array<double>").select("i", fan(F.col("v")).alias("n")).collect()}
    for i in (0, 1):  # wound away from the camera, so turned round
        assert np.allclose(np.reshape(got[i], (4, 3)), [0, 0, 1])
    assert got[2] == [0.0] * 12 and [got[i] for i in (3, 4, 5, 7)] == [None] * 4
    assert np.allclose(got[6][:12], got[0]) and got[6][12:] == [0, 0, 0]


def test_frames_by_ordinal(spark):
    numbered = spark.createDataFrame([("a", 0, 10), ("a", 1, 12), (None, 0, 10)], "s string, ordinal int, frame int")
    stored = spark.createDataFrame([("a", 0, "x"), (None, 0, "z"), ("a", None, "lost")], "s string, ordinal int, picture string")
    wanted = spark.createDataFrame([("a", 10, 1), ("a", 10, 1), ("a", 11, 2), ("a", 12, 3), (None, 10, 4), ("b", 10, 5), ("a", None, 6)], "s string, frame int, `a.b` int")
    got = sorted(map(tuple, frames_by_ordinal(wanted, numbered, stored, ["s"], "frame").collect()), key=lambda r: r[2])
    assert got == [("a", 10, 1, 0, "x"), ("a", 10, 1, 0, "x"), ("a", 11, 2, None, None), ("a", 12, 3, 1, None), (None, 10, 4, 0, "z"), ("b", 10, 5, None, None), ("a", None, 6, None, None)]
    empty = frames_by_ordinal(wanted.where("false"), numbered, stored, ["s"], "frame")
    assert empty.columns == ["s", "frame", "a.b", "ordinal", "picture"] and empty.count() == 0
    with pytest.raises(ValueError, match="picture"):
        frames_by_ordinal(wanted.withColumn("picture", F.lit(1)), numbered, stored, ["s"], "frame")
