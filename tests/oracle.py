"""Rows of a query against those of its DuckDB text."""

from __future__ import annotations

from decimal import Decimal
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float | Decimal):
        return round(float(v), 6)
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


def check(spark, run, sql: str, sf_dir: str = SF) -> None:
    con = duckdb.connect()
    for p in Path(sf_dir).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = run(spark, sf_dir)
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    a = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    b = sorted(repr([plain(v) for v in r]) for r in want.fetchall())
    assert a == b
