"""Compares a registered query with its SQL in DuckDB, values rounded to nine places."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd


def cell(x) -> str:
    if x is None or (not hasattr(x, "__len__") and pd.isna(x)):
        return "null"
    if isinstance(x, float):
        return str(int(x)) if x.is_integer() else repr(round(x, 9))
    return str([cell(v) for v in x]) if hasattr(x, "__len__") and not isinstance(x, str | bytes | bytearray) else str(x)


def rows(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    return sorted(tuple(cell(x) for x in r) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


def same(spark, queries, sql, name: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found, expected = queries[name](spark, sf_dir).toPandas(), con.execute(sql[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found) == rows(expected)
