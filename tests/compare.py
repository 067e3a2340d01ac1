"""Spark result against DuckDB on the same tables, order-insensitive, by column name."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{os.path.join(sf_dir, name)}.parquet'")
    return con


def _cell(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows), [columns[i] for i in order]


def compare(df, con, sql: str) -> str:
    """Empty when equal, else a short description of the first difference."""
    got, names = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want, wnames = _rows([d[0] for d in cur.description], cur.fetchall())
    if names != wnames:
        return f"columns {names} / {wnames}"
    if len(got) != len(want):
        extra = [r for r in got[:5000] if r not in set(want)][:3]
        return f"rows {len(got)} / {len(want)} extra {extra}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(bad)} of {len(got)} rows differ, first {bad[0]}" if bad else ""
