"""Compares the registered queries with their SQL in DuckDB, by columns in name order and rows in any order."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    if isinstance(v, dict):
        return tuple((k, _plain(x)) for k, x in sorted(v.items()))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def difference(spark, query, sql: str, sf_dir: str) -> str:
    """Empty if both give the same rows, else what differs."""
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    want = [dict(zip(names, r)) for r in got.fetchall()]
    df = query(spark, sf_dir)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    have = [r.asDict(recursive=True) for r in df.collect()]
    rows = [sorted((tuple(_plain(r[c]) for c in sorted(names)) for r in side), key=repr) for side in (have, want)]
    if rows[0] == rows[1]:
        return ""
    odd = [next((r for r in a if r not in set(b)), None) for a, b in (rows, rows[::-1])]
    return f"{len(have)} and {len(want)} rows; only in one: {odd}"[:600]
