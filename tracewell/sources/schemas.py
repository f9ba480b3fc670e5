"""Schemas of the frame tables, and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: table layouts
_DDL = {
    "detections": "clip_id string, frame_idx long, det_id long, track_id long, subject_id long, bbox array<float>, score float, embedding array<float>",
    "tubelets": "clip_id string, track_id long, rider_role string, frame_idx long, timestamp_ms long, bbox array<float>, det_score float, depth double, scene_phase string, embedding array<float>, crop_ref string",
    "features": "clip_id string, track_id long, rider_role string, frame_idx long, feature_space string, feature array<float>",
    "landmarks": "clip_id string, track_id long, rider_role string, frame_idx long, landmarks array<float>, transform array<float>, crop_box array<float>, blendshapes array<float>",
    "scene": "clip_id string, frame_idx long, embedding array<float>, customer_embedding array<float>, bg_embedding array<float>, model string",
    "parse": "clip_id string, track_id long, frame_idx long, eyes_vis double, mouth_vis double, glasses_frac double, eye_lum_rel double, hat_frac double, cloth_frac double, skin_frac double, skin_lum double, skin_clip_hi double, skin_clip_lo double, skin_contrast double, skin_entropy double, face_micro double",
    "headpose": "clip_id string, track_id long, frame_idx long, yaw double, pitch double, roll double",
    "emotion_frame": "clip_id string, track_id long, frame_idx long, valence double, em_conf double, arousal double",
    "candidates": "clip_id string, track_id long, rider_role string, product string, track string, pick struct<frame_idx:long,score:double>, timestamp string, alternatives array<struct<frame_idx:long,score:double>>, scores map<string,double>",
    "verdicts": "clip_id string, track_id long, rider_role string, product string, a_frame long, b_frame long, a_span array<long>, b_span array<long>, system_pref string, winner string",
    "labels": "clip_id string, track_id long, product string, frame_idx long, verdict string, note string",
    "ground_truth": "schema string, clip string, frame long, role string, flag string, corpus string, ts string",
}


def schema(table: str) -> T.StructType:
    """The schema of a table; a session must be running, as its parser reads the layout."""
    return T.StructType.fromDDL(_DDL[table])


#: Columns that are NULL where the table is optional or the reading failed; all others must be present and not NULL.
NULLABLE = {"embedding", "depth", "customer_embedding", "note", "scores", "alternatives"}


def conformed(df: DataFrame, table: str) -> DataFrame:
    """df with exactly the table's columns, in order and cast. A missing or unknown column raises; so does, when it runs, a value that does not cast."""
    want, have = set(schema(table).names), set(df.columns)
    if want != have:
        raise ValueError(f"{table}: missing {sorted(want - have)}, unknown {sorted(have - want)}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema(table).fields])


def without_nan(df: DataFrame) -> DataFrame:
    """NaN is missing: scalar floats become NULL, and so do entries of float arrays."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            out[f.name] = F.when(~F.isnan(f.name), F.col(f.name))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.FloatType, T.DoubleType)):
            out[f.name] = F.transform(f.name, lambda x: F.when(~F.isnan(x), x))
    return df.withColumns(out) if out else df


def require(df: DataFrame, contract: T.StructType) -> DataFrame:
    """df, if it has every field of the contract in a fitting type; fields beyond it are allowed."""
    have = {f.name: f.dataType for f in df.schema.fields}
    for f in contract.fields:
        if f.name not in have:
            raise ValueError(f"field {f.name} is missing")
        if have[f.name].simpleString() != f.dataType.simpleString():
            raise ValueError(f"field {f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}")
    return df
