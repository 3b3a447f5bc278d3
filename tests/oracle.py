"""Compares a query with its SQL in DuckDB."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb


def _plain(v: object) -> object:
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    if getattr(v, "tzinfo", None):
        return v.replace(tzinfo=None)
    return float(v) if type(v).__name__ == "Decimal" else v


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    want = result.fetchall()
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    got = Counter(tuple(_plain(r[c]) for c in order) for r in df.collect())
    expected = Counter(tuple(_plain(r[names.index(c)]) for c in order) for r in want)
    assert got == expected
