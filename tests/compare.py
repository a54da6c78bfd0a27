"""Compare a registered query with its SQL on the same tables."""

from __future__ import annotations

import math

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if value is None:
        return "~"
    if isinstance(value, float):
        return "~" if math.isnan(value) else repr(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def difference(df, con, sql) -> str | None:
    """None when equal, else what differs."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = rows_of(names, cursor.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if expected[0] != got[0]:
        return f"columns {got[0]} instead of {expected[0]}"
    if len(expected[1]) != len(got[1]):
        return f"{len(got[1])} rows instead of {len(expected[1])}: only here {sorted(set(got[1]) - set(expected[1]))[:3]}, missing {sorted(set(expected[1]) - set(got[1]))[:3]}"
    wrong = [(g, e) for g, e in zip(got[1], expected[1]) if g != e]
    return f"{len(wrong)} of {len(got[1])} rows differ, first {wrong[0]}" if wrong else None
