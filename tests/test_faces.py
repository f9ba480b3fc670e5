import math

import numpy as np
from pyspark.sql import functions as F

from tracewell.functions import faces


def symmetric_face():
    rng = np.random.default_rng(3)
    p = rng.uniform(0, 100, (478, 3))
    place = lambda i, x, y: p.__setitem__(i, (x, y, 0.0))
    for eye, side in ((faces.RIGHT_EYE, -1), (faces.LEFT_EYE, 1)):
        place(eye["outer"], 50 + side * 30, 40)
        place(eye["inner"], 50 + side * 10, 44)
        place(eye["top"], 50 + side * 20, 38)
        place(eye["bottom"], 50 + side * 20, 46)
    for k, (r, l) in enumerate(zip(faces.RIGHT_BROW, faces.LEFT_BROW)):
        x, y = 10 + 3 * k, 30 - (k == 4) * 6
        place(r, 50 - x, y)
        place(l, 50 + x, y)
    for name, x, y in (("tip", 50, 60), ("bridge", 50, 42), ("right", 44, 62), ("left", 56, 62), ("base", 50, 64)):
        place(faces.NOSE[name], x, y)
    for name, x, y in (("right", 35, 74), ("left", 65, 74), ("top", 50, 75), ("bottom", 50, 79), ("upper_lip", 50, 72), ("lower_lip", 50, 83)):
        place(faces.MOUTH[name], x, y)
    for name, x, y in (("chin", 50, 100), ("forehead", 50, 10), ("right", 5, 50), ("left", 95, 50), ("right_jaw", 20, 85), ("left_jaw", 80, 85), ("right_bone", 12, 55), ("left_bone", 88, 55)):
        place(faces.FACE[name], x, y)
    return p


def axes(spark, p):
    df = spark.createDataFrame([([float(v) for v in p.ravel()],)], "p array<double>")
    return faces.face_axes(df, "p").first()["axes"]


def test_axes_of_a_symmetric_face(spark):
    a = axes(spark, symmetric_face())
    assert len(a) == 37
    assert all(abs(a[n] - a[n.replace("_L", "_R")]) < 1e-9 for n in a.asDict() if "_L" in n)
    want = {
        "face_width_height_ratio": 1.0, "jaw_face_width_ratio": 60 / 90, "cheekbone_face_width_ratio": 76 / 90, "forehead_face_height_ratio": 28 / 90, "face_symmetry_score": 1.0, "inter_eye_face_width_ratio": 40 / 90,
        "chin_angle_deg": 2 * math.degrees(math.atan2(30, 15)), "eye_tilt_L_deg": math.degrees(math.atan2(4, 20)), "eye_height_ratio_L": 8 / math.hypot(20, 4), "philtrum_length_ratio": 8 / 90, "mouth_width_ratio": 30 / 90,
        "mouth_corner_angle_deg": math.degrees(math.atan2(3, 2)), "chin_length_ratio": 23 / 90, "brow_length_ratio_R": 27 / 20, "brow_thickness_ratio_R": 6 / 20, "brow_arch_height_R": 6 / 27, "brow_slope_R_deg": 0.0,
        "brow_eye_distance_ratio": 8 / 90, "inter_brow_distance_ratio": 20 / 90, "face_thirds_balance": 1 - 1.5 * max(abs(x / 90 - 1 / 3) for x in (28, 26, 36)),
    }
    for name, value in want.items():
        assert abs(a[name] - value) < 1e-6, (name, a[name], value)
    assert a["mouth_corner_class"] == "high"


def test_axes_need_a_face(spark):
    p = symmetric_face()
    p[faces.LEFT_EYE["inner"]] = p[faces.RIGHT_EYE["inner"]]
    assert axes(spark, p) is None
    p = symmetric_face()
    p[faces.NOSE["tip"], 0] += 20
    assert axes(spark, p)["face_symmetry_score"] < 0.5


def test_ratios(spark):
    df = spark.createDataFrame([([float(v) for v in symmetric_face().ravel()],)], "p array<double>")
    row = df.select(*[v.alias(k) for k, v in faces.face_ratios(F.col("p")).items()]).first()
    assert abs(row["face_aspect"] - 1) < 1e-9 and abs(row["eye_spacing"] - 20 / math.hypot(20, 4)) < 1e-9 and abs(row["lower_face"] - 36 / 90) < 1e-9 and abs(row["lip_fullness"] - 11 / 36) < 1e-9
