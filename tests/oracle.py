"""Compare a query with its SQL: same columns by name, same multiset of rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def _plain(x):
    if x is None or x is pd.NaT or x is pd.NA:
        return None
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if hasattr(x, "item"):
        return _plain(x.item())
    return str(x) if isinstance(x, pd.Timestamp) else x


def rows(frame: pd.DataFrame) -> Counter:
    names = sorted(frame.columns)
    return Counter(tuple(map(_plain, r)) for r in frame[names].itertuples(index=False, name=None))


def assert_same(spark_frame: pd.DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> int:
    expected = con.execute(sql).df()
    assert sorted(spark_frame.columns) == sorted(expected.columns)
    got, want = rows(spark_frame), rows(expected)
    assert got == want, f"only here: {list((got - want).items())[:3]}, only in SQL: {list((want - got).items())[:3]}"
    return len(expected)
