"""Rows of a query and of its SQL in DuckDB, in a form that compares."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, bool):
        return str(value)
    return repr(float(value)) if isinstance(value, float) else str(value)


def rows(records, columns) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in records)


def duck(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    found = con.sql(sql)
    return list(found.columns), found.fetchall()


def compare(spark, sf_dir: str, query, sql: str) -> None:
    df = query(spark, sf_dir)
    columns, expected = duck(sf_dir, sql)
    assert sorted(df.columns) == sorted(columns)
    got = rows([tuple(r) for r in df.collect()], df.columns)
    want = rows(expected, columns)
    assert got == want, f"{len(got)} and {len(want)} rows; first different: {next(((a, b) for a, b in zip(got, want, strict=False) if a != b), None)}"
