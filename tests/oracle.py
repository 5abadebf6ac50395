"""Compares a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from pathlib import Path

import duckdb


def plain(value):
    """A value in a form that both engines share: floats rounded to nine digits, times without zone, lists as tuples."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (bytearray, memoryview)):
        return bytes(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, dict):
        return tuple(sorted((plain(k), plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def duck(sf_dir: str, sql: str):
    """(column names, rows) of SQL over the tables of sf_dir."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    found = con.execute(sql)
    return [d[0] for d in found.description], found.fetchall()


def same_rows(query, sql: str, spark, sf_dir: str) -> None:
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    columns, rows = duck(sf_dir, sql)
    assert sorted(columns) == names
    order = [columns.index(n) for n in names]
    want = Counter(tuple(plain(r[i]) for i in order) for r in rows)
    got = Counter(tuple(plain(r[n]) for n in names) for r in df.collect())
    assert sum(got.values()) == sum(want.values())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
