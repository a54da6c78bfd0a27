"""Scans whose state passes from row to row and has no window form.

Spark sorts the rows of every task by entity and order, and Python takes them batch by batch, so a task holds one batch and
one entity. An entity over the budget is cut in time: a first pass turns each of its chunks into a small summary that maps the
incoming state to the outgoing one, the summaries are folded per entity, and the second pass runs every chunk from its
incoming state. Chunks are streamed like entities, however many there are. Without such entities one pass does it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import CHUNK, chunk_of, chunk_width, for_python, names, null_safe_join, row_budget


def scan(df: DataFrame, by, t: str, tie, out_schema: str, *, run: Callable, summarise: Callable, enter: Callable, start) -> DataFrame:
    """Sequential scan per entity; the result has the entity columns and those of out_schema.

    run(columns, state) gets one entity's ordered rows as arrays and returns the places of the rows
    that go out and a dict of new columns for them; other columns of out_schema are taken from the
    rows. summarise(columns) gives a text form of the chunk's state map and enter(summary, state)
    applies it. `start` is the state before the first row.
    """
    keys, order = names(by), [t, *names(tie)]
    schema = T.StructType([df.schema[k] for k in keys] + list(T.StructType.fromDDL(out_schema).fields))
    width = chunk_width(df, keys, t)

    def outputs(rows: pd.DataFrame, bounds: list, state_at: Callable) -> pd.DataFrame:
        columns = {c: rows[c].to_numpy() for c in rows.columns}
        places, made = [], []
        for low, high in bounds:
            picked, fresh = run({c: a[low:high] for c, a in columns.items()}, state_at(columns, low))
            places.append(np.asarray(picked, dtype=np.int64) + low)
            made.append(fresh)
        taken = np.concatenate(places)
        fresh = {c: np.concatenate([m[c] for m in made]) for c in made[0]}
        return pd.DataFrame({f.name: _column(fresh[f.name] if f.name in fresh else columns[f.name][taken], f) for f in schema.fields})

    if width is None:
        return streamed(df, keys, order, lambda rows, bounds: outputs(rows, bounds, lambda *_: start), schema)

    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > row_budget(df)).select(*keys, F.lit(True).alias("__hot"))
    marked = null_safe_join(df, hot, keys, "left").withColumn("__hot", F.coalesce("__hot", F.lit(False)))
    place = F.coalesce(chunk_of(t, width), F.lit(-(2**63)))         # rows without a time come first
    chunked = marked.withColumn(CHUNK, F.when(F.col("__hot"), place).otherwise(F.lit(0)).cast("long"))
    key_fields = [df.schema[k] for k in keys]
    map_schema = T.StructType(key_fields + [T.StructField(CHUNK, T.LongType()), T.StructField("__map", T.StringType())])
    state_schema = T.StructType(key_fields + [T.StructField(CHUNK, T.LongType()), T.StructField("__state", T.StringType())])

    def summaries(rows: pd.DataFrame, bounds: list) -> pd.DataFrame:
        columns = {c: rows[c].to_numpy() for c in rows.columns}
        maps = [summarise({c: a[low:high] for c, a in columns.items()}) for low, high in bounds]
        firsts = rows.iloc[[low for low, _ in bounds]]
        return pd.DataFrame({**{f.name: _column(firsts[f.name].to_numpy(), f) for f in map_schema.fields[:-1]}, "__map": maps})

    def fold(rows: pd.DataFrame, bounds: list) -> pd.DataFrame:
        maps, states = rows["__map"].tolist(), []
        for low, high in bounds:
            state = start
            for text in maps[low:high]:
                states.append(json.dumps(state))
                state = enter(text, state)
        return pd.DataFrame({**{f.name: _column(rows[f.name].to_numpy(), f) for f in state_schema.fields[:-1]}, "__state": states})

    maps = streamed(chunked.where("__hot"), [*keys, CHUNK], order, summaries, map_schema)
    states = streamed(maps, keys, [CHUNK], fold, state_schema)
    ready = null_safe_join(chunked, states, [*keys, CHUNK], "left")

    def state_at(columns, low):
        text = columns["__state"][low]
        return start if text is None else json.loads(text)

    return streamed(ready, [*keys, CHUNK], order, lambda rows, bounds: outputs(rows, bounds, state_at), schema)


def streamed(df: DataFrame, parts: list[str], order: list[str], work: Callable, schema: T.StructType) -> DataFrame:
    """work(rows, bounds) over whole groups of equal `parts`, as many as a batch ends; their rows are in order.

    A task holds a batch and the group that is open at its end, never all groups it gets.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            before = held[-1].iloc[-1:] if held else batch.iloc[:0]
            firsts = _firsts(pd.concat([before, batch], ignore_index=True) if held else batch, parts)[1 if held else 0:] - len(before)
            if held and not len(firsts):
                held.append(batch)
                continue
            open_at = int(firsts[-1])
            done = _whole([*held, batch.iloc[:open_at]])
            if len(done):
                yield work(done, _bounds(done, parts))
            held = [batch.iloc[open_at:]]
        if held:
            done = _whole(held)
            yield work(done, _bounds(done, parts))

    return for_python(df, *parts).sortWithinPartitions(*parts, *order).mapInPandas(run, schema)


def _whole(pieces: list[pd.DataFrame]) -> pd.DataFrame:
    pieces = [p for p in pieces if len(p)]
    return pd.concat(pieces, ignore_index=True) if len(pieces) > 1 else pieces[0].reset_index(drop=True) if pieces else pd.DataFrame()


def _firsts(rows: pd.DataFrame, parts: list[str]) -> np.ndarray:
    """The places at which a group begins; null parts are equal."""
    changed = np.zeros(len(rows), dtype=bool)
    for part in parts:
        now, before = rows[part], rows[part].shift()
        changed |= ((now != before) & ~(now.isna() & before.isna())).to_numpy()
    changed[0] = True
    return np.flatnonzero(changed)


def _bounds(rows: pd.DataFrame, parts: list[str]) -> list[tuple[int, int]]:
    """The (first, end) places of every group."""
    firsts = _firsts(rows, parts).tolist()
    return list(zip(firsts, [*firsts[1:], len(rows)]))


def _column(values, field: T.StructField):
    if isinstance(field.dataType, (T.LongType, T.IntegerType)):
        return pd.array(values, dtype="Int64")
    return values
