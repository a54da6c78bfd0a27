"""Change points that count only when the value leaves a band around the last accepted one."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sequential
from .ordered import Ordered, as_column, names


def hysteresis_changes(df: DataFrame, by, t: str, tie, value, band: float) -> DataFrame:
    """Rows whose value differs by more than `band` from the last accepted value; the first counts.

    Rows without a value, or with one that is no number, are no changes. Rows equal to the row before
    them cannot change the state and are dropped first.
    """
    keys = names(by)
    valued = df.select(*keys, t, *names(tie), as_column(value).cast("double").alias("__v"))
    o = Ordered.of(valued.where(F.col("__v").isNotNull() & ~F.isnan("__v")), by, t, tie)
    moved = o.prev(__pv="__v").df.where(F.col("__pv").isNull() | (F.col("__pv") != F.col("__v"))).drop("__pv")
    tie_types = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in [t, *names(tie)])
    return sequential.scan(
        moved, by, t, tie, f"{tie_types}, value double",
        run=lambda rows, state: _accepted(rows["__v"], state, band),
        summarise=lambda rows: _summary(rows["__v"], band),
        enter=lambda text, state: _enter(text, state, band), start=None)


def _accepted(values: np.ndarray, state, band: float):
    keep, last = [], state
    for i, v in enumerate(values.tolist()):
        if last is None or abs(v - last) > band:
            keep.append(i)
            last = v
    return keep, {"value": values[keep]}


def _leaves(values: np.ndarray, i: int, band: float) -> int | None:
    """First later place whose value is outside the band around the value at i."""
    begin, size = i + 1, 64
    while begin < len(values):
        far = np.abs(values[begin:begin + size] - values[i]) > band
        if far.any():
            return begin + int(far.argmax())
        begin, size = begin + size, size * 2
    return None


def _summary(values: np.ndarray, band: float) -> str:
    """Where an incoming state can first be left, and the state at the end from there.

    The first row outside the band around some incoming value is always a new greatest or a new least
    value of the chunk, so these records with their outcomes describe the chunk for every state. A state
    more than a band from the first value is left at once, so records more than two bands from it are never asked
    for, but the first of them.
    """
    outcome: dict[int, float] = {}

    def follow(i: int) -> float:
        walked = []
        while i not in outcome:
            walked.append(i)
            following = _leaves(values, i, band)
            if following is None:
                outcome[i] = float(values[i])
                break
            i = following
        for place in walked:
            outcome[place] = outcome[i]
        return outcome[i]

    top = np.maximum.accumulate(values)
    bottom = np.minimum.accumulate(values)
    rises = [0, *(np.flatnonzero(np.diff(top) > 0) + 1).tolist()]
    falls = [0, *(np.flatnonzero(np.diff(bottom) < 0) + 1).tolist()]
    far = lambda places: next((n + 1 for n, i in enumerate(places) if abs(values[i] - values[0]) > 2 * band), len(places))
    rises, falls = rises[:far(rises)], falls[:far(falls)]
    return json.dumps({name: [[i, float(values[i]), follow(i)] for i in places]
                       for name, places in (("up", rises), ("down", falls))})


def _enter(text: str, state, band: float):
    records = json.loads(text)
    if state is None:
        return records["up"][0][2]
    up = next((r for r in records["up"] if r[1] - state > band), None)
    down = next((r for r in records["down"] if state - r[1] > band), None)
    first = min((r for r in (up, down) if r is not None), default=None)
    return state if first is None else first[2]
