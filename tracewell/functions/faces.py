"""Geometry of a face from landmarks: an array of x, y, z triples in image pixels (y down).

The axes are a table: what is measured, between which landmarks, against which scale. One select computes them all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TINY = 1e-6
# fixed values: landmark numbers of the 468-point mesh
RIGHT_EYE = {"outer": 33, "inner": 133, "top": 159, "bottom": 145}
LEFT_EYE = {"outer": 263, "inner": 362, "top": 386, "bottom": 374}
MOUTH = {"right": 61, "left": 291, "top": 13, "bottom": 14, "upper_lip": 0, "lower_lip": 17}
FACE = {"chin": 152, "forehead": 10, "right": 234, "left": 454, "right_jaw": 172, "left_jaw": 397, "right_bone": 117, "left_bone": 346}
NOSE = {"tip": 1, "bridge": 6, "right": 49, "left": 279, "base": 2}
RIGHT_BROW = (70, 63, 105, 66, 107, 55, 65, 52, 53, 46)
LEFT_BROW = (300, 293, 334, 296, 336, 285, 295, 282, 283, 276)
PAIRS = ((33, 263), (133, 362), (159, 386), (145, 374), (61, 291), (172, 397), (234, 454))
#: Least distance of the inner eye corners (pixels) for a face to be measured; and mouth corners below and above which a mouth counts as low or high.
LEAST_EYES, LOW_CORNER, HIGH_CORNER = 1e-3, -3.0, 5.0


class _Points:
    def __init__(self, points: Column):
        self.points = points

    def x(self, i: int) -> Column:
        return F.get(self.points, 3 * i).cast("double")

    def y(self, i: int) -> Column:
        return F.get(self.points, 3 * i + 1).cast("double")

    def apart(self, i: int, j: int) -> Column:
        return F.hypot(self.x(i) - self.x(j), self.y(i) - self.y(j))

    def corner(self, a: int, at: int, b: int) -> Column:
        """Angle at a landmark, in degrees."""
        ax, ay, bx, by = self.x(a) - self.x(at), self.y(a) - self.y(at), self.x(b) - self.x(at), self.y(b) - self.y(at)
        size = F.hypot(ax, ay) * F.hypot(bx, by)
        return F.when(size > _TINY, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ax * bx + ay * by) / size))))).otherwise(0.0)


def _rise(outer_x: Column, outer_y: Column, inner_x: Column, inner_y: Column) -> Column:
    """Degrees by which the outer end lies above the inner one, alike on both sides."""
    wide = F.abs(outer_x - inner_x)
    return F.when(wide > _TINY, F.degrees(F.atan2(inner_y - outer_y, wide))).otherwise(0.0)


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _brow(p: _Points, brow: tuple[int, ...], centre: Column) -> dict[str, Column]:
    """Inner and outer end (nearest to and farthest from the centre line), highest point and lowest y."""
    ends = F.array(*[F.struct(F.abs(p.x(i) - centre).alias("gap"), F.lit(-k).alias("k"), p.x(i).alias("x"), p.y(i).alias("y")) for k, i in enumerate(brow)])
    first = F.array(*[F.struct(F.abs(p.x(i) - centre).alias("gap"), F.lit(k).alias("k"), p.x(i).alias("x"), p.y(i).alias("y")) for k, i in enumerate(brow)])
    top = F.array(*[F.struct(p.y(i).alias("y"), F.lit(k).alias("k"), p.x(i).alias("x")) for k, i in enumerate(brow)])
    return {"inner": F.array_min(first), "outer": F.array_max(ends), "top": F.array_min(top), "low": F.greatest(*[p.y(i) for i in brow])}


def face_axes(rows: DataFrame, points: str) -> DataFrame:
    """rows with `axes`, a struct of 36 measures and the class of the mouth's corners; NULL where the inner eye corners coincide or points are missing."""
    p = _Points(F.col(points))
    centre = p.x(NOSE["tip"])
    rows = rows.withColumns({"__r": F.struct(*[v.alias(k) for k, v in _brow(p, RIGHT_BROW, centre).items()]), "__l": F.struct(*[v.alias(k) for k, v in _brow(p, LEFT_BROW, centre).items()])})
    eyes = p.apart(RIGHT_EYE["inner"], LEFT_EYE["inner"])
    wide, tall = (F.greatest(p.apart(*e), F.lit(_TINY)) for e in ((FACE["right"], FACE["left"]), (FACE["forehead"], FACE["chin"])))
    brow_line, forehead, base, chin = (p.y(RIGHT_EYE["top"]) + p.y(LEFT_EYE["top"])) / 2, p.y(FACE["forehead"]), p.y(NOSE["base"]), p.y(FACE["chin"])
    middle = (p.y(MOUTH["top"]) + p.y(MOUTH["bottom"])) / 2
    above = lambda a, b: F.greatest(b - a, F.lit(0.0))
    out: dict[str, Column] = {
        "face_width_height_ratio": p.apart(FACE["right"], FACE["left"]) / tall,
        "jaw_face_width_ratio": p.apart(FACE["right_jaw"], FACE["left_jaw"]) / wide,
        "chin_angle_deg": p.corner(FACE["right_jaw"], FACE["chin"], FACE["left_jaw"]),
        "cheekbone_face_width_ratio": p.apart(FACE["right_bone"], FACE["left_bone"]) / wide,
        "forehead_face_height_ratio": above(forehead, brow_line) / tall,
        "inter_eye_face_width_ratio": F.hypot(*[(f(LEFT_EYE["outer"]) + f(LEFT_EYE["inner"]) - f(RIGHT_EYE["outer"]) - f(RIGHT_EYE["inner"])) / 2 for f in (p.x, p.y)]) / wide,
        "nose_width_ratio": p.apart(NOSE["right"], NOSE["left"]) / wide,
        "nose_length_ratio": p.apart(NOSE["bridge"], NOSE["tip"]) / tall,
        "nose_bridge_length_ratio": F.hypot(*[f(NOSE["bridge"]) - (f(NOSE["right"]) + f(NOSE["left"])) / 2 for f in (p.x, p.y)]) / tall,
        "nose_tip_angle_deg": p.corner(NOSE["right"], NOSE["tip"], NOSE["left"]),
        "upper_lip_thickness_ratio": p.apart(MOUTH["upper_lip"], MOUTH["top"]) / tall,
        "lower_lip_thickness_ratio": p.apart(MOUTH["bottom"], MOUTH["lower_lip"]) / tall,
        "mouth_width_ratio": p.apart(MOUTH["right"], MOUTH["left"]) / wide,
        "mouth_corner_angle_deg": _sum([F.degrees(F.atan2(middle - p.y(MOUTH[s]), eyes * 0.1)) for s in ("left", "right")]) / 2,
        "philtrum_length_ratio": p.apart(NOSE["base"], MOUTH["upper_lip"]) / tall,
        "chin_length_ratio": above(middle, chin) / tall,
    }
    thirds = [above(forehead, brow_line), above(brow_line, base), above(base, chin)]
    uneven = F.greatest(*[F.abs(t / F.nullif(_sum(thirds), F.lit(0.0)) - 1 / 3) for t in thirds])
    out["face_thirds_balance"] = F.coalesce(1 - 1.5 * uneven, F.lit(0.0))
    pairs = [(F.abs(p.x(b) - p.x(a)), F.abs((p.x(a) + p.x(b)) / 2 - centre)) for a, b in PAIRS]
    off = _sum([F.when(w > _TINY, gap / w).otherwise(0.0) for w, gap in pairs]) / F.nullif(_sum([(w > _TINY).cast("int") for w, _ in pairs]), F.lit(0))
    out["face_symmetry_score"] = F.coalesce(1 - F.least(off * 2, F.lit(1.0)), F.lit(1.0))
    lid = []
    for side, eye, brow in (("L", LEFT_EYE, F.col("__l")), ("R", RIGHT_EYE, F.col("__r"))):
        width, height = p.apart(eye["outer"], eye["inner"]), p.apart(eye["top"], eye["bottom"])
        out[f"eye_width_ratio_{side}"] = width / wide
        out[f"eye_height_ratio_{side}"] = out[f"eye_aspect_{side}"] = height / F.greatest(width, F.lit(_TINY))
        out[f"eye_tilt_{side}_deg"] = _rise(p.x(eye["outer"]), p.y(eye["outer"]), p.x(eye["inner"]), p.y(eye["inner"]))
        dx, dy = brow["outer"]["x"] - brow["inner"]["x"], brow["outer"]["y"] - brow["inner"]["y"]
        length = F.hypot(dx, dy)
        out[f"brow_length_ratio_{side}"] = length / eyes
        out[f"brow_thickness_ratio_{side}"] = (brow["low"] - brow["top"]["y"]) / eyes
        from_line = F.abs(dx * (brow["top"]["y"] - brow["inner"]["y"]) - dy * (brow["top"]["x"] - brow["inner"]["x"])) / (length + _TINY)
        out[f"brow_arch_height_{side}"] = F.when(length > _TINY, from_line / length).otherwise(0.0)
        out[f"brow_slope_{side}_deg"] = _rise(brow["outer"]["x"], brow["outer"]["y"], brow["inner"]["x"], brow["inner"]["y"])
        lid.append(above(brow["low"], p.y(eye["top"])))
    out["brow_eye_distance_ratio"] = _sum(lid) / 2 / tall
    out["inter_brow_distance_ratio"] = F.abs(F.col("__l.inner.x") - F.col("__r.inner.x")) / wide
    angle = out["mouth_corner_angle_deg"]
    out["mouth_corner_class"] = F.when(angle < LOW_CORNER, "low").when(angle > HIGH_CORNER, "high").otherwise("mid")
    return rows.withColumn("axes", F.when(eyes >= LEAST_EYES, F.struct(*[v.alias(k) for k, v in out.items()]))).drop("__r", "__l")


def face_ratios(points: Column) -> dict[str, Column]:
    """Seven proportions of a shape in space."""

    def apart(i: int, j: int) -> Column:
        return F.sqrt(_sum([F.pow(F.get(points, 3 * i + k) - F.get(points, 3 * j + k), 2) for k in range(3)]))

    # fixed values: the bridge here is another landmark than that of the axes
    bridge = 168
    eye = (apart(RIGHT_EYE["outer"], RIGHT_EYE["inner"]) + apart(LEFT_EYE["inner"], LEFT_EYE["outer"])) / 2
    tall, wide, lower = apart(FACE["forehead"], FACE["chin"]), apart(FACE["right"], FACE["left"]), apart(NOSE["base"], FACE["chin"])
    return {
        "face_aspect": tall / wide,
        "eye_spacing": apart(RIGHT_EYE["inner"], LEFT_EYE["inner"]) / eye,
        "eye_face": eye / wide,
        "nose_length": apart(bridge, NOSE["base"]) / tall,
        "lower_face": lower / tall,
        "mouth_width": apart(MOUTH["right"], MOUTH["left"]) / wide,
        "lip_fullness": apart(MOUTH["upper_lip"], MOUTH["lower_lip"]) / lower,
    }
