"""The likeness record of a track: what its frames say about a face that does not change, lane by lane, as one nested row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators import moments
from tracewell.operators.alignment import assembled
from tracewell.operators.selection import best_per_bin, greedy_separated
from tracewell.plans.readings import component_probes, top_dimensions


def likeness_records(rows: DataFrame, keys: Sequence[str], frame: str, shape: str, blend: str | None, names: Sequence[str], probes: Sequence[str], size: int = 3, parts: int = 3, gap: int = 18, k: int = 3) -> DataFrame:
    """keys, then a struct for each lane: shape (n, centre, drift of its halves), components (axes, explained, residual), axes (what each component goes with), neutral (the shape at rest, by
    ridge regression on the blend vector), expression (calm frames, strongest blend entries), samples (the k best frames, apart), views (the best frame of each view).

    rows: keys, frame, the shape and blend vectors, the probes, score, view and calm. `size` entries of a shape are a point. Without a blend vector neutral and
    expression are NULL; a lane that finds nothing in a track is NULL there.
    """
    fitted = moments.components(rows, keys, shape, parts=parts, size=size)
    scored = moments.component_scores(rows.where(F.col(shape).isNotNull()), fitted, keys, shape)
    first = rows.where(F.col(shape).isNotNull()).select(F.size(shape)).first()
    width = min(parts, first[0]) if first else 0
    pcs = [f"pc{i + 1}" for i in range(width)]
    named = scored.select(*keys, *probes, *[F.col("scores")[i].alias(p) for i, p in enumerate(pcs)])
    lanes: dict[str, DataFrame | None] = {
        "shape": moments.shape_summary(rows, keys, frame, shape, size=size),
        "components": fitted.select(*keys, "axes", "explained", "residual"),
        "axes": _listed(component_probes(named, keys, pcs, probes), keys, ["component", "rank", "probe", "corr"]) if pcs else None,
        "neutral": None,
        "expression": None,
        "samples": _frames(greedy_separated(rows, keys, frame, "score", k, gap), keys, frame),
        "views": _listed(best_per_bin(rows, keys, "view", "score", frame), keys, ["view", frame, "score"]),
    }
    if blend is not None:
        lanes["neutral"] = moments.ridge(rows, keys, blend, shape, frame, size=size).drop("n")
        top = _listed(top_dimensions(rows, keys, blend, names), keys, ["rank", "name", "median", "p90"])
        calm = rows.groupBy(*keys).agg(F.count_if("calm").alias("n_calm"), F.avg(F.coalesce("calm", F.lit(False)).cast("int")).alias("calm_ratio"))
        lanes["expression"] = calm.join(top.withColumnRenamed("found", "strongest"), list(keys), "left")
    return assembled(lanes, keys, "shape")


def _listed(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """keys, found: a few rows a key as a sorted list."""
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("found"))


def _frames(picks: DataFrame, keys: Sequence[str], frame: str) -> DataFrame:
    return picks.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("pick", frame))), lambda x: x[frame]).alias("frames"))
