"""Named bundles of thresholds."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Preset:
    # fixed values: thresholds of the rules, in the order of the signals they bound
    fps: float = 6.0
    frontal_yaw: float = 15.0
    side_yaw: float = 50.0
    side_agree: float = 30.0
    sunglasses_below: float = 0.7
    masked_below: float = 0.01
    blur_part: float = 0.5
    blur_least: int = 10
    entropy_least: float = 4.5
    identity_slack: float = 0.12
    anchor_most: float = 0.32
    rival_margin: float = 0.05
    self_strong: float = 0.42
    self_side: float = 0.30
    self_gross: float = 0.15
    blink_most: float = 0.45
    query_most: float = 0.38
    expression_least: float = 0.30
    jaw_most: float = 0.5
    pose_most: float = 20.0
    side_run: int = 3
    side_gap: int = 2
    centroid_least: int = 10


PRESETS = {"default": Preset()}


def preset(name: str) -> Preset:
    if name not in PRESETS:
        raise KeyError(f"no preset {name!r}; known: {sorted(PRESETS)}")
    return PRESETS[name]


def preset_table(spark: SparkSession) -> DataFrame:
    rows = [(name, key, float(value)) for name, p in PRESETS.items() for key, value in asdict(p).items()]
    return spark.createDataFrame(rows, "preset string, name string, value double")
