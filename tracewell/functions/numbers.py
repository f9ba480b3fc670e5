"""Scalar column expressions. NULL is the only missing value here; sources turn NaN into NULL on the way in."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def null_if_nan(x: Column) -> Column:
    return F.nanvl(x.cast("double"), F.lit(None).cast("double"))


def dim(vector: Column, index: int) -> Column:
    """One entry of a vector column as a double; NULL beyond its end or where it is NaN."""
    return null_if_nan(F.get(vector, index))


def clip(x: Column, low: float, high: float) -> Column:
    """x held to [low, high]; NULL stays NULL."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def unit(x: Column, low: Column | float, high: Column | float, flat: float | None = 0.5) -> Column:
    """(x - low) / (high - low) held to [0, 1]; `flat` where the range is empty."""
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.coalesce(clip((x - low) / F.nullif(high - low, F.lit(0.0)), 0.0, 1.0), F.lit(flat).cast("double"))


def preference(x: Column, centre: float, width: float, missing: float) -> Column:
    """exp(-(x - centre)^2 / 2 width^2), `missing` where x is NULL."""
    return F.coalesce(F.exp(-F.pow(x - centre, 2) / (2 * width * width)), F.lit(missing))


def point_distance(values: Mapping[str, Column], target: Mapping[str, float], weight: Mapping[str, float]) -> Column:
    """Weighted Euclidean distance to an authored point; NULL if a value is."""
    return F.sqrt(reduce(lambda a, b: a + b, [F.lit(weight[k]) * F.pow(values[k] - target[k], 2) for k in target]))


def mean_of(values: Sequence[Column]) -> Column:
    """Mean over those that are not NULL; NULL if all are."""
    total = reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0.0)) for v in values])
    count = reduce(lambda a, b: a + b, [v.isNotNull().cast("int") for v in values])
    return total / F.nullif(count, F.lit(0))


def fused(first: Sequence[Column], second: Sequence[Column]) -> tuple[list[Column], Column]:
    """All values of the first source where its first value is present, else all of the second; and which one it was."""
    here = first[0].isNotNull()
    picked = [F.when(here, a).otherwise(b) for a, b in zip(first, second)]
    return picked, F.when(here, "first").when(second[0].isNotNull(), "second")


def view_class(mesh_yaw: Column, wide_yaw: Column, frontal: float = 15.0, side: float = 50.0, agree: float = 30.0) -> Column:
    """frontal, angle or side from two yaw readings (degrees).

    Side is decided first, by the wide reading, unless the mesh reading contradicts it (small, or of the other sign).
    """
    wide_side = F.coalesce(F.abs(wide_yaw) >= side, F.lit(False))
    backed = mesh_yaw.isNull() | ((F.abs(mesh_yaw) >= agree) & (F.signum(mesh_yaw) == F.signum(wide_yaw)))
    return F.when(wide_side & F.coalesce(backed, F.lit(False)), "side").when(F.abs(mesh_yaw) < frontal, "frontal").when(mesh_yaw.isNotNull() | wide_yaw.isNotNull(), "angle")


def euler(matrix: Column) -> tuple[Column, Column, Column]:
    """(yaw, pitch, roll) in degrees of a row-major 4x4 transform."""
    m = lambda i: dim(matrix, i)
    yaw = F.degrees(F.atan2(-m(8), F.hypot(m(0), m(4))))
    return yaw, F.degrees(F.atan2(m(9), m(10))), F.degrees(F.atan2(m(4), m(0)))


def valence(happy: Column, negative: Sequence[Column]) -> Column:
    """Positive minus negative evidence; a missing part counts 0, NULL only if all are missing."""
    parts = [happy, *negative]
    total = F.coalesce(happy, F.lit(0.0)) - reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0.0)) for x in negative])
    return F.when(F.coalesce(*parts).isNotNull(), total)


def first_greatest(values: Column, labels: Sequence[str]) -> Column:
    """The label of the greatest entry of an array, the first of equals."""
    return F.element_at(F.array(*[F.lit(x) for x in labels]), F.array_position(values, F.array_max(values)).cast("int"))


def softmax(values: Column) -> Column:
    """Softmax of an array of doubles."""
    top = F.array_max(values)
    powers = F.transform(values, lambda x: F.exp(x - top))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def balanced_pair(left: Column, right: Column, apart: float = 0.55) -> Column:
    """Mean of two unit readings; if they are farther apart than `apart`, the one nearer the middle."""
    nearer = F.when(F.abs(left - 0.5) <= F.abs(right - 0.5), left).otherwise(right)
    return F.when(F.abs(left - right) > apart, nearer).otherwise((left + right) / 2)


def circular(x: Column, period: float) -> tuple[Column, Column]:
    turn = x * (2 * 3.141592653589793 / period)
    return F.sin(turn), F.cos(turn)


def signed_unit(x: Column, low: float, high: float) -> Column:
    """x mapped from [low, high] to [-1, 1]."""
    return 2 * (x - low) / (high - low) - 1


def in_arc(x: Column, low: float, high: float) -> Column:
    """Whether an angle lies in [low, high]; low > high wraps around."""
    return x.between(low, high) if low <= high else (x >= low) | (x <= high)


def passes(bounds: Mapping[str, tuple[float | None, float | None]]) -> Column:
    """All bounds hold; a NULL reading passes."""
    tests = [F.lit(True)]
    for name, (low, high) in bounds.items():
        x = F.col(name)
        if low is not None:
            tests.append(x.isNull() | (x >= low))
        if high is not None:
            tests.append(x.isNull() | (x <= high))
    return reduce(lambda a, b: a & b, tests)


def portrait_box(left: Column, top: Column, right: Column, bottom: Column, width: Column, height: Column, grow: float = 1.6) -> Column:
    """A 4:5 box around a face box, held to the frame, in whole pixels (rounded half to even)."""
    side = F.greatest(right - left, bottom - top) * grow
    cx, cy = (left + right) / 2, (top + bottom) / 2
    half_w, half_h = side * 0.5, side * 0.625
    edge = lambda x, most: F.bround(F.greatest(F.lit(0.0), F.least(most, x))).cast("int")
    return F.struct(edge(cx - half_w, width).alias("x1"), edge(cy - half_h, height).alias("y1"), edge(cx + half_w, width).alias("x2"), edge(cy + half_h, height).alias("y2"))


def box_features(left: Column, top: Column, right: Column, bottom: Column, width: Column, height: Column) -> dict[str, Column]:
    cx, cy = (left + right) / 2, (top + bottom) / 2
    return {
        "centre_distance": F.hypot(cx / width - 0.5, cy / height - 0.5),
        "area_ratio": (right - left) * (bottom - top) / (width * height),
        "aspect": (right - left) / F.nullif(bottom - top, F.lit(0.0)),
    }


def with_sentinels(values: Mapping[str, Column], missing: Mapping[str, float], places: int = 2) -> list[Column]:
    """Rounded columns with a stand-in for NULL, for screens that read numbers only."""
    return [F.coalesce(F.bround(v, places), F.lit(missing[k])).alias(k) for k, v in values.items()]
