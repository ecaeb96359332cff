"""Rows of a Spark query against DuckDB's on the same tables."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str, sql: str):
    c = duckdb.connect()
    for n in TABLES:
        p = f"{sf_dir}/{n}.parquet"
        c.sql(f"CREATE VIEW {n} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return c.sql(sql).df()


def value(v):
    if v is None or (isinstance(v, float) and v != v) or str(v) in ("NaT", "<NA>"):
        return "null"
    if isinstance(v, bool) or type(v).__name__ == "bool":
        return str(bool(v))
    try:
        return f"{float(v):.6f}"
    except (TypeError, ValueError):
        return str(v)


def rows(df) -> list[tuple]:
    cols = sorted(df.columns)
    return sorted(tuple(value(v) for v in r) for r in df[cols].itertuples(index=False))


def assert_same(spark, sf_dir, query, sql) -> None:
    mine, other = query(spark, sf_dir).toPandas(), duck(sf_dir, sql)
    assert sorted(mine.columns) == sorted(other.columns)
    assert rows(mine) == rows(other)
