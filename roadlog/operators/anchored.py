"""Windows that open at an event and close at the first event a window length later."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sequential
from .ordered import Ordered, gridded, names


def anchored_windows(df: DataFrame, by, t: str, *, slot: int, length: int) -> DataFrame:
    """Greedy windows of `length` slots: by, start (first slot), n events, closed.

    The first event opens a window; the first event at least `length` slots after the opening one
    opens the next. Time counts in whole slots (the logs have seconds), so rows are first counted per
    entity and slot; rows without a time belong to no window. The last window has closed = false.

    Where a window opens follows from the slot of the one before alone. A chunk of a long recording is therefore summarised by
    the last opening that each of its first `length` slots leads to; with the openings known, a slot's window is the last
    opening before it, and windows are counted like any group.
    """
    keys = names(by)
    timed = df.where(F.col(t).isNotNull())
    counted = timed.groupBy(*keys, F.floor(F.col(t) / F.lit(slot)).cast("long").alias("slot")).agg(F.count(F.lit(1)).alias("c"))
    with gridded(timed, by, t, slot, "slot", 1):
        opened = sequential.scan(
            counted, by, "slot", (), "slot long, c long, opens long", run=lambda rows, last: _openings(rows["slot"], last, length),
            summarise=lambda rows: _summary(rows["slot"], length), enter=lambda text, last: _enter(text, last, length), start=None)
        windows = Ordered.of(opened, by, "slot").running(start=("last", "opens")).df.groupBy(*keys, "start").agg(F.sum("c").alias("n"))
        followed = Ordered.of(windows.withColumn("slot", F.col("start")), by, "slot").next(__next="start").df
    return followed.select(*keys, "start", "n", F.col("__next").isNotNull().alias("closed"))


def _openings(slots: np.ndarray, last: int | None, length: int):
    """All places, and the slots of those that open a window, after a window that opened at `last`."""
    opens = np.full(len(slots), None, dtype=object)
    at = 0 if last is None else int(np.searchsorted(slots, last + length))
    while at < len(slots):
        opens[at] = slots[at]
        at = int(np.searchsorted(slots, slots[at] + length))
    return np.arange(len(slots)), {"opens": opens}


def _summary(slots: np.ndarray, length: int) -> str:
    """The slots with events among the chunk's first `length` and the one behind these, each with the last opening it leads to."""
    after = np.searchsorted(slots, slots + length).tolist()
    last = slots.tolist()
    for at in range(len(last) - 1, -1, -1):
        if after[at] < len(last):
            last[at] = last[after[at]]
    entries = int(np.searchsorted(slots, slots[0] + length)) + 1
    return json.dumps([slots[:entries].tolist(), last[:entries]])


def _enter(text: str, last: int | None, length: int) -> int:
    slots, leads = json.loads(text)
    at = 0 if last is None else int(np.searchsorted(slots, last + length))
    return leads[at] if at < len(slots) else last
