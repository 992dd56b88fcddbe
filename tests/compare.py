"""Holds a query's rows against its SQL on the same tables."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, list):
        return tuple(map(plain, v))
    return v


def rows(names: list[str], data) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


def difference(spark, query, sql: str, sf_dir: str) -> str:
    """Empty if names and rows agree."""
    df = query(spark, sf_dir)
    got = rows(df.columns, (tuple(r) for r in df.collect()))
    cur = connection(sf_dir).execute(sql)
    names = [d[0] for d in cur.description]
    want = rows(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got != want:
        return f"{sum(got.values())} rows, SQL has {sum(want.values())}; only here {list((got - want).items())[:2]}; only there {list((want - got).items())[:2]}"
    return "" if got else "no rows"
