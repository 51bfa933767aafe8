"""Rows of a Spark query and of its SQL in DuckDB, in one comparable form."""

from __future__ import annotations

import datetime

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)


def sql_rows(c: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    out = c.sql(sql)
    cols = sorted(out.columns)
    at = [out.columns.index(x) for x in cols]
    return cols, sorted((tuple(plain(r[i]) for i in at) for r in out.fetchall()), key=repr)
