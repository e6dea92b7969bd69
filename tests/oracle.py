"""Runs a query and its SQL and compares the rows."""

from __future__ import annotations

import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v if v is None or isinstance(v, (bool, int)) else str(v)


def order(row):
    return tuple((v is None, not isinstance(v, (int, float)), v if v is not None else 0) for v in row)


def compare(df, con, sql: str) -> None:
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=order)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=order)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert all(a == b or (isinstance(a, float) and isinstance(b, (float, int)) and math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-5)) for a, b in zip(g, w, strict=True)), (g, w)
