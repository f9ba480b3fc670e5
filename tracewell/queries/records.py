"""One record of all scores of a frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.plans.scores import SCORES, frame_scores
from tracewell.queries.book import SIGNALS, Book, rounded, signals

BOOK = Book()

#: The readings that the scores need, of the signals; each is missing in some frames.
READINGS = {
    "valence": "CASE WHEN frame_idx % 17 <> 16 THEN CAST(smile AS DOUBLE) - CAST(jaw AS DOUBLE) END",
    "em_conf": "CASE WHEN frame_idx % 4 <> 3 THEN CAST(em_conf AS DOUBLE) END",
    "neutral": "CASE WHEN frame_idx % 5 <> 0 THEN 1 - CAST(smile AS DOUBLE) END",
    "energy": "CAST(blink AS DOUBLE)",
    "det": "CASE WHEN frame_idx % 6 <> 5 THEN CAST(eye_lum_rel AS DOUBLE) / 2 END",
    "yaw": "CAST(yaw AS DOUBLE)",
    "valid": "wide_yaw > -40",
    "scene_phase": "CASE WHEN frame_idx >= 10 THEN 'ride' WHEN frame_idx < 8 THEN 'boarding' END",
    "blur": "CAST(blur AS DOUBLE)",
    "exposure": "CAST(eye_lum_rel AS DOUBLE) / 2",
    "clipped": "CAST(mouth_vis AS DOUBLE)",
    "crushed": "CAST(iddev AS DOUBLE) / 10",
    "blink": "CAST(blink AS DOUBLE)",
    "smile": "CASE WHEN frame_idx % 7 <> 6 THEN CAST(smile AS DOUBLE) END",
    "center_dist": "CASE WHEN frame_idx % 3 <> 0 THEN CAST(cos_self AS DOUBLE) END",
    "light_lr": "CAST(cos_other AS DOUBLE) - 0.5",
    "light_tb": "CAST(skin_entropy AS DOUBLE) / 7",
    "ambient": "CAST(pitch AS DOUBLE)",
    "rarity": "CASE WHEN frame_idx > 2 THEN CAST(iddev AS DOUBLE) * 10 END",
    "scene": "CASE WHEN frame_idx % 9 <> 8 THEN CAST(skin_entropy AS DOUBLE) - 3 END",
    "jaw": "CAST(jaw AS DOUBLE)",
    "pitch": "CAST(pitch AS DOUBLE)",
    "roll": "CAST(roll AS DOUBLE)",
}
CHANGES = {"expression": (["smile", "jaw"], "sum"), "pose": (["yaw", "pitch"], "sum"), "light": (["clipped", "crushed"], "max"), "speed": (["roll", "blur"], "hypot")}

_T, _W = "OVER (PARTITION BY track_id)", "OVER (PARTITION BY track_id ORDER BY frame_idx)"
_FILLED = {**{n: f"coalesce({n}, median({n}) {_T})" for n in ("smile", "jaw", "yaw", "pitch", "roll", "blur")}, **{n: f"coalesce({n}, 0)" for n in ("clipped", "crushed")}}
_STEPS = ", ".join(f"abs(CASE WHEN lag(1) {_W} IS NULL THEN lead(f_{n}) {_W} - f_{n} WHEN lead(1) {_W} IS NULL THEN f_{n} - lag(f_{n}) {_W} ELSE (lead(f_{n}) {_W} - lag(f_{n}) {_W}) / 2 END) AS g_{n}" for n in _FILLED)
_Z = ("expression", "pose", "light", "speed", "rare")


def _unit(x: str) -> str:
    return f"(({x} - min({x}) {_T}) / (max({x}) {_T} - min({x}) {_T} + 1e-9))"


_JOY = _unit("greatest(coalesce(valence, 0), 0)")
_RIDE = "is_ride AND n >= min(CASE WHEN is_ride THEN n END) OVER (PARTITION BY track_id) + 18"


@BOOK.add("q01_frame_scores", f"""WITH {SIGNALS}, r0 AS MATERIALIZED (SELECT track_id, frame_idx, {', '.join(f'{sql} AS {name}' for name, sql in READINGS.items())} FROM s), r1 AS (SELECT *, {', '.join(f'{x} AS f_{n}' for n, x in _FILLED.items())} FROM r0), r2 AS (SELECT *, {_STEPS} FROM r1),
    r3 AS (SELECT *, g_smile + g_jaw AS c_expression, g_yaw + g_pitch AS c_pose, greatest(g_clipped, g_crushed) AS c_light, sqrt(g_roll * g_roll + g_blur * g_blur) AS c_speed, rarity AS c_rare FROM r2),
    r4 AS (SELECT *, {', '.join(f'median(c_{c}) {_T} AS m_{c}' for c in _Z)} FROM r3), r5 AS (SELECT *, {', '.join(f'median(abs(c_{c} - m_{c})) {_T} AS d_{c}' for c in _Z)} FROM r4),
    r6 AS (SELECT *, {', '.join(f'CASE WHEN c_{c} IS NOT NULL THEN greatest((c_{c} - m_{c}) / (d_{c} * 1.4826 + 1e-9), 0) END AS z_{c}' for c in _Z)} FROM r5),
    r7 AS MATERIALIZED (SELECT *, (z_expression + z_pose + z_light + z_speed) / 4 AS impact, coalesce(scene_phase = 'ride', false) AS is_ride, row_number() {_W} AS n, {_unit('blur')} - 2 * abs(exposure - 0.45) - 3 * (clipped + crushed) AS q,
        least(1, greatest(0, CASE WHEN valence IS NOT NULL THEN 0.5 + 0.5 * valence END)) * CASE WHEN valence IS NOT NULL THEN 1 END * (coalesce(det, 0) * (0.3 + 0.7 * coalesce(exp(-pow(yaw - 12, 2) / 1800), 0.25))) * (0.4 + 0.6 * coalesce(em_conf, 0.5)) * CAST(valid AS INTEGER) AS which FROM r6),
    r8 AS MATERIALIZED (SELECT *, greatest(impact, z_rare, scene, 3 * greatest(valence, 0)) AS moment, greatest(impact, scene, 3 * greatest(valence, 0)) * which AS ranked, {_RIDE} AS counts, {_unit('q')} AS q01,
        coalesce(1 - 0.6 * blink, 0.75) AS eyes, 0.5 + 0.5 * coalesce(0.5 * {_unit('smile')} + 0.5 * {_JOY}, {_JOY}) AS pleasant, coalesce(exp(-pow(center_dist / (2 * coalesce(median(center_dist) {_T}, 1) + 1e-9), 2)), 1) AS typical,
        (1 + 0.2 * {_unit('abs(coalesce(light_lr, 0))')}) * (1 - 0.25 * least(0.5, greatest(0, abs(coalesce(light_tb, 0)) - 0.45)) / 0.5) * (1 + 0.2 * {_unit('coalesce(ambient, 0)')}) AS light FROM r7)
    SELECT track_id, frame_idx, round(coalesce(exp(-pow(yaw - 12, 2) / 800), 0.05) * (0.3 + 0.7 * (coalesce(neutral, 0.5) * (1 - 0.5 * coalesce(energy, 0)))) * (0.2 + 0.8 * q01) * (0.4 + 0.6 * coalesce(em_conf, 0.5)) * CASE WHEN is_ride THEN 1.0 ELSE 1.15 END + 1e-8, 5) AS likeness,
    round((0.2 + 0.8 * q01) * eyes * pleasant * (0.4 + 0.6 * coalesce(em_conf, 0.5)) * light * typical * coalesce(det, 0) + 1e-8, 5) AS portrait, round(which + 1e-8, 5) AS which, round(impact + 1e-8, 4) AS impact, round(z_rare + 1e-8, 4) AS rarity, round(scene + 1e-8, 5) AS scene, round(CASE WHEN counts THEN moment END + 1e-8, 4) AS "when",
    round(CASE WHEN counts THEN ranked END + 1e-8, 4) AS rank_sig, round(CASE WHEN counts THEN moment * which END + 1e-8, 4) AS highlight, is_ride, round(z_speed + 1e-8, 4) AS speed, round(light + 1e-8, 5) AS light FROM r8""")
def q01(spark: SparkSession, d: str) -> DataFrame:
    own = signals(spark, d).selectExpr("track_id", "frame_idx", *[f"{sql} AS {name}" for name, sql in READINGS.items()])
    out = frame_scores(own, ["track_id"], "frame_idx", CHANGES).withColumns({"speed": F.col("impact_terms.speed"), "light": F.col("portrait_terms.light")})
    # products of short decimals can lie half way between two rounded values
    nudged = out.withColumns({n: F.col(n) + 1e-8 for n in (*SCORES, "speed", "light")}).select("track_id", "frame_idx", *SCORES, "is_ride", "speed", "light")
    return rounded(rounded(nudged, "impact", "rarity", "when", "rank_sig", "highlight", "speed", places=4), "likeness", "portrait", "which", "scene", "light", places=5)
