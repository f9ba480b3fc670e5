"""Readings of pictures and meshes held in array columns: gray pixels row by row, points as x, y, z after each other.

Arrow batches are cut by shape, and all pictures of one shape are read at once. A picture that is NULL, holds NULL or a value that is not finite, has fewer than 3 rows or columns, or
a length other than height * width has NULL in every reading; so has a mesh whose length is not three times a whole number, or that lacks a point of the triangles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pixels from which on a picture counts as clipped, and up to which as crushed; a surface is crushed a little later.
CLIPPED, CRUSHED, SURFACE_CRUSHED = 250, 5, 6
#: Weights above this belong to a surface, and the fewest pixels of one that is judged.
LEAST_WEIGHT, LEAST_PIXELS = 1e-3, 50

PICTURE = ["blur", "exposure", "contrast", "clipped", "crushed", "light_lr", "light_tb", "light_harsh"]
SURFACE = ["lum", "clip_hi", "clip_lo", "contrast", "entropy", "micro"]


def _finite(v: object) -> np.ndarray | None:
    if v is None:
        return None
    a = np.asarray(v, dtype=np.float64)
    return a if np.isfinite(a).all() else None


def _by_shape(heights: pd.Series, widths: pd.Series, *arrays: pd.Series) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Places of the rows of one shape, and their arrays as (rows, height, width)."""
    shapes: dict[tuple[int, int], list[tuple[int, list[np.ndarray]]]] = {}
    for i, (h, w, *own) in enumerate(zip(heights, widths, *arrays)):
        if pd.isna(h) or pd.isna(w) or min(h, w) < 3:
            continue
        found = [_finite(v) for v in own]
        if all(a is not None and len(a) == h * w for a in found):
            shapes.setdefault((int(h), int(w)), []).append((i, found))
    for (h, w), rows in shapes.items():
        yield [i for i, _ in rows], [np.stack(x).reshape(-1, h, w) for x in zip(*[found for _, found in rows])]


def _stencil(pictures: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Each pixel's weighted neighbours; beyond an edge the picture is mirrored at its last pixels."""
    r, (h, w) = len(kernel) // 2, pictures.shape[1:]
    wide = np.pad(pictures, ((0, 0), (r, r), (r, r)), mode="reflect")
    return sum(k * wide[:, y : y + h, x : x + w] for (y, x), k in np.ndenumerate(kernel) if k)


# fixed values: the stencils
EDGES = np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]])
DIAGONAL_EDGES = np.array([[2, 0, 2], [0, -8, 0], [2, 0, 2]])
SMOOTH = np.outer([1, 4, 6, 4, 1], [1, 4, 6, 4, 1]) / 256


def _picture(p: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    h, w = p.shape[1:]
    light, all_of = _stencil(p, SMOOTH), (1, 2)
    left, right, top, low = (x.mean(axis=all_of) for x in (light[:, :, : w // 2], light[:, :, w // 2 :], light[:, : h // 2], light[:, h // 2 :]))
    steps = np.abs(np.gradient(light, axis=1)) + np.abs(np.gradient(light, axis=2))
    read = [_stencil(p, EDGES).var(axis=all_of), p.mean(axis=all_of) / 255, p.std(axis=all_of) / 255, (p >= CLIPPED).mean(axis=all_of), (p <= CRUSHED).mean(axis=all_of)]
    read += [(left - right) / (left + right + 1e-6), (top - low) / (top + low + 1e-6), np.median(steps, axis=all_of) / 255]
    cuts = [[(i * n // 3, (i + 1) * n // 3) for i in range(3)] for n in (h, w)]
    sectors = np.stack([p[:, a:b, c:d].mean(axis=all_of) / 255 for a, b in cuts[0] for c, d in cuts[1]], axis=1)
    return np.stack(read, axis=1), list(sectors)


def picture_stats(pixels: Column, height: Column, width: Column) -> Column:
    """A struct of blur (variance of the Laplacian), exposure, contrast, clipped, crushed, light_lr, light_tb, light_harsh, and sectors: the means of 3 x 3 fields, row by row.

    Pixels are 0 to 255; exposure, contrast, harshness and sectors are shares of 255. Light is read from the smoothed picture: left against right, top against bottom, and the
    median step between neighbours. Callers who want light at one resolution resize before.
    """

    @F.pandas_udf(", ".join(f"{n} double" for n in PICTURE) + ", sectors array<double>")
    def read(pixels: pd.Series, height: pd.Series, width: pd.Series) -> pd.DataFrame:
        out, sectors = np.full((len(pixels), len(PICTURE)), np.nan), [None] * len(pixels)
        for places, (pictures,) in _by_shape(height, width, pixels):
            out[places], found = _picture(pictures)
            for i, s in zip(places, found):
                sectors[i] = s
        return pd.DataFrame(out, columns=PICTURE).assign(sectors=sectors)  # NaN becomes NULL on the way back

    return read(pixels, height, width)


def _surface(v: np.ndarray, weight: np.ndarray, edge: np.ndarray) -> list[float]:
    total = weight.sum()
    mean = (v * weight).sum() / total
    spread = ((v - mean) ** 2 * weight).sum() / total
    held = np.histogram(v, bins=256, range=(0.0, 256.0), weights=weight)[0]
    share = held[held > 0] / held.sum()
    middle = (edge * weight).sum() / total
    return [mean, weight[v >= CLIPPED].sum() / total, weight[v <= SURFACE_CRUSHED].sum() / total, np.sqrt(spread) / (mean + 1e-6), -(share * np.log2(share)).sum() + 0.0, ((edge - middle) ** 2 * weight).sum() / total]


def surface_stats(pixels: Column, weights: Column, height: Column, width: Column) -> Column:
    """A struct of lum, clip_hi, clip_lo, contrast, entropy (256 bins, bits) and micro (variance of the Laplacian) of the weighted pixels; NULL under 50 pixels of weight."""

    @F.pandas_udf(", ".join(f"{n} double" for n in SURFACE))
    def read(pixels: pd.Series, weights: pd.Series, height: pd.Series, width: pd.Series) -> pd.DataFrame:
        out = np.full((len(pixels), len(SURFACE)), np.nan)
        for places, (pictures, weight) in _by_shape(height, width, pixels, weights):
            edges, inside = _stencil(pictures, DIAGONAL_EDGES), weight > LEAST_WEIGHT
            for i, p, own, edge, m in zip(places, pictures, weight, edges, inside):
                if m.sum() >= LEAST_PIXELS:
                    out[i] = _surface(p[m], own[m], edge[m])
        return pd.DataFrame(out, columns=SURFACE)

    return read(pixels, weights, height, width)


def vertex_normals(triangles: Sequence[tuple[int, int, int]]) -> Callable[[Column], Column]:
    """From a mesh's points (x, y, z after each other) its points' unit normals in the same order: the sum of the cross products of a point's triangles.

    All normals of a mesh are turned round if their mean z is negative, so they look at the camera. A point of no triangle has the normal 0, 0, 0. The triangles travel with the code.
    """
    corners = np.asarray(triangles, dtype=np.int64).reshape(-1, 3)

    @F.pandas_udf("array<double>")
    def read(points: pd.Series) -> pd.Series:
        out: list[np.ndarray | None] = [None] * len(points)
        sizes: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, v in enumerate(points):
            a = _finite(v)
            if a is not None and len(a) and len(a) % 3 == 0 and len(a) // 3 > corners.max(initial=-1):
                sizes.setdefault(len(a), []).append((i, a))
        for rows in sizes.values():
            v = np.stack([a for _, a in rows]).reshape(len(rows), -1, 3)
            a, b, c = (v[:, corners[:, k]] for k in range(3))
            face, total = np.cross(b - a, c - a), np.zeros_like(v)
            for k in range(3):
                np.add.at(total, (slice(None), corners[:, k]), face)
            total /= np.linalg.norm(total, axis=2, keepdims=True) + 1e-9
            total = np.where(total[:, :, 2].mean(axis=1)[:, None, None] < 0, -total, total)
            for (i, _), n in zip(rows, total):
                out[i] = n.ravel()
        return pd.Series(out, dtype="object")

    return read
