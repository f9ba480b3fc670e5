"""A rule set over frames: named references (one value a track) and gates (one boolean a frame), each declaring what it reads.

A reference is an aggregate over its track as a windowed column, a gate a boolean column closed over NULL, so a rule set is a few projections and
one exchange by track.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    name: str
    reads: tuple[str, ...]
    make: Callable[[], Column]
    is_gate: bool = True


def unresolved(rules: Sequence[Rule], signals: Sequence[str]) -> list[tuple[str, str]]:
    """(rule, name) of all reads that neither a signal nor an earlier rule provides."""
    known, missing = set(signals), []
    for rule in rules:
        missing += [(rule.name, r) for r in rule.reads if r not in known]
        known.add(rule.name)
    return missing


def readers(rules: Sequence[Rule], names: Sequence[str]) -> list[Rule]:
    """The rules that read one of the names, directly or through another rule, in order."""
    known, found = set(names), []
    for rule in rules:
        if known & set(rule.reads):
            known.add(rule.name)
            found.append(rule)
    return found


def evaluated(frames: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """frames with one column for each rule, in order. Unknown reads raise before anything runs. A gate's NULL is false."""
    if lost := unresolved(rules, frames.columns):
        raise ValueError(f"reads without a source: {lost}")
    pending: dict[str, Column] = {}
    for rule in rules:
        if set(rule.reads) & pending.keys():  # it reads what is not there yet: one more projection
            frames, pending = frames.withColumns(pending), {}
        made = rule.make()
        pending[rule.name] = F.coalesce(made, F.lit(False)) if rule.is_gate else made
    return frames.withColumns(pending) if pending else frames


def first_reason(cases: Sequence[tuple[Column, str]], rest: str) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for test, name in cases:
        out = out.when(test, name)
    return out.otherwise(rest)
