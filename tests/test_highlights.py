"""Clips' highlights against a plain account of the rules."""

import itertools
import math
import random
from statistics import mean, median

from pyspark.sql import functions as F

from tracewell.plans.highlights import CHANNELS, SIGNALS, clip_highlights

DDL = "clip string, track long, role string, frame long, ms long, " + ", ".join(f"`{s}` double" for s in SIGNALS) + ", s1 double, s2 double, junk string"


def rows(seed):
    rng, out = random.Random(seed), []
    for clip, tracks, n in (("a", 3, 160), ("b", 1, 90), ("c", 2, 8), (None, 2, 120)):
        for t in range(tracks):
            ms, phase = 0, rng.random() * 6
            for f in range(n):
                ms = f * 180 + (2600 if f > n // 2 else 0)
                if rng.random() < 0.1:
                    continue
                own = {s: None if rng.random() < 0.12 else round(abs(math.sin(f / 9 + phase)) * 3 + rng.random(), 3) for s in SIGNALS}
                own["valence"] = None if rng.random() < 0.1 else round(math.sin(f / 13 + phase) * 0.5, 3)
                state = [None if rng.random() < 0.1 else round(math.cos(f / 17 + phase + i) * 2, 3) for i in range(2)]
                out.append((clip, 10 + t, "main" if t == 1 else "guest", f, ms, *own.values(), *state, "x"))
    return out


def expected(data, clip):
    mine = [r for r in data if r[0] == clip]
    frames = sorted({r[3] for r in mine})
    joint = {}
    for f in frames:
        here = [r for r in mine if r[3] == f]
        one = {s: max((r[5 + i] for r in here if r[5 + i] is not None), default=None) for i, s in enumerate(SIGNALS)}
        full = [r[-3:-1] for r in here if None not in r[-3:-1]]
        joint[f] = {**one, "ms": max(r[4] for r in here), "state": [mean(c) for c in zip(*full)] or [0.0, 0.0]}
    line = [joint[f] for f in frames]
    if sum(x["when"] is not None for x in line) < 10:
        return []
    level = []
    for i in range(len(line)):
        near = [x["when"] for x in line[max(0, i - 1) : i + 2] if x["when"] is not None]
        level.append(median(near) if near else None)
    free, moments = set(range(len(line))), []
    peaks = [i for i in range(1, len(line) - 1) if line[i]["when"] is not None and None not in level[i - 1 : i + 2] and level[i] >= max(level[i - 1], level[i + 1])]
    for i in sorted(peaks, key=lambda i: -level[i]):
        if i not in free:
            continue
        span = [i]
        for step in (-1, 1):
            j = i + step
            while j in free and level[j] is not None and level[j] > level[i] / 2 and abs(line[j]["ms"] - line[i]["ms"]) <= 6000 and abs(line[j]["ms"] - line[j - step]["ms"]) <= 2000:
                span.append(j)
                j += step
        if len(span) >= 3:
            free -= set(span)
            start, last = max(0, line[i]["ms"] - 1500), max(span)
            moments.append({"i": i, "start": start, "score": max(line[j]["rank_sig"] or 0.0 for j in span), "kind": [mean(line[j]["state"][d] for j in span) for d in (0, 1)], "resolved": last + 1 < len(line) and level[last + 1] is not None, "span": sorted(span)})
    moments.sort(key=lambda m: -m["score"])
    apart = [math.dist(a["kind"], b["kind"]) for a, b in itertools.combinations(moments, 2)]
    least, chosen = median(apart) / 2 if apart else 0.0, []
    for m in moments:
        inside = [x for x in line if m["start"] <= x["ms"] <= m["start"] + 3000]
        joy, energy = [x["valence"] for x in inside if x["valence"] is not None], [x["arousal"] for x in inside if x["arousal"] is not None]
        sad = joy and mean(joy) < -0.1 and not (energy and mean(energy) >= 0.3)
        if len(chosen) < 3 and not sad and all(math.dist(m["kind"], c["kind"]) >= least and 3000 - abs(m["start"] - c["start"]) <= 750 for c in chosen):
            chosen.append(m)
    out = []
    for rank, m in enumerate(chosen, 1):
        shown = [j for j, x in enumerate(line) if m["start"] <= x["ms"] <= m["start"] + 3000 and x["which"] is not None] or [j for j in m["span"] if line[j]["which"] is not None] or [m["i"]]
        rep = max(shown, key=lambda j: (line[j]["which"] if line[j]["which"] is not None else 0, -j))
        top = line[m["i"]]
        drivers = {c: top[c] or 0.0 for c in CHANNELS} | {"valence": 3 * max(top["valence"] or 0.0, 0.0)}
        out.append((rank, frames[m["i"]], frames[rep], m["start"], m["start"] + 3000, m["resolved"], round(m["score"], 3), tuple(round(v + 1e-12, 2) for v in drivers.values()), max(drivers, key=drivers.get)))
    return out


def test_against_a_plain_account(spark):
    many = 0
    for seed in (1, 2, 3):
        data = rows(seed)
        found = {r["clip"]: r for r in clip_highlights(spark.createDataFrame(data, DDL), "clip", "track", "role", "frame", "ms", ["s1", "s2"]).collect()}
        assert set(found) == {"a", "b", "c", None}
        for clip, r in found.items():
            got = [(s.rank, s.when_frame, s.peak_frame, s.start_ms, s.end_ms, s.resolved, s.score, tuple(round(x, 2) for x in s.drivers), s.driver) for s in r.segs]
            assert got == expected(data, clip), (seed, clip)
            assert r.n_segs == len(got) and r.riders_joined == len({x[1] for x in data if x[0] == clip}) and r.main_track == (10 if clip == "b" else 11)
            many += len(got)
        assert found["c"].n_segs == 0 and found["c"].segs == []
    assert many > 10


def test_empty_tables_and_rows_without_places(spark):
    none = spark.createDataFrame([], DDL)
    assert clip_highlights(none, "clip", "track", "role", "frame", "ms", ["s1", "s2"]).collect() == []
    lost = spark.createDataFrame(rows(1), DDL).withColumn("frame", F.lit(None).cast("long"))
    assert {r.n_segs for r in clip_highlights(lost, "clip", "track", "role", "frame", "ms", ["s1", "s2"]).collect()} == {0}
