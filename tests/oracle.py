"""Runs a query in Spark and its statement in DuckDB and compares the rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for table in TABLES:
        path = f"{sf_dir}/{table}.parquet"
        con.execute(f"create view {table} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)) or value.__class__.__name__ == "Decimal":
        return round(float(value), 9)
    return value if isinstance(value, str) else str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


def compare(spark, con, fn, sql: str, sf_dir: str) -> int:
    df = fn(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = rows_of(names, result.fetchall())
    assert sorted(df.columns) == sorted(names)
    if mine != theirs:
        a, b = set(mine), set(theirs)
        raise AssertionError(f"{[r for r in mine if r not in b][:3]} against {[r for r in theirs if r not in a][:3]}")
    return len(mine)
