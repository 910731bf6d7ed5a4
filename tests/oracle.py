"""Comparing a query's rows with its oracle SQL's, cell by cell, whatever the order."""

from __future__ import annotations

import datetime
import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        inner = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{inner}'")
    return con


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, float):
        return f"{x:.9g}"
    if isinstance(x, (datetime.datetime, datetime.date)):
        return x.isoformat()
    return str(x)


def rows(columns: list[str], data: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if ``df`` and the SQL give the same rows."""
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = rows(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got == want:
        return ""
    g, w = set(got), set(want)
    return f"{len(got)} and {len(want)} rows; only here {sorted(g - w)[:3]}; only in SQL {sorted(w - g)[:3]}"
