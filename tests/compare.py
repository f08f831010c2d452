"""Results of queries held against DuckDB: rows as sorted tuples, equal in every value."""

from __future__ import annotations

import datetime
import math
from decimal import Decimal

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connected(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def order(row):
    return tuple((v is None, f"{v:.6f}" if isinstance(v, float) else str(v)) for v in row)


def difference(df, con, sql: str) -> str | None:
    """What differs between a DataFrame and a query's result, or None."""
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=order)
    result = con.execute(sql)
    columns = [x[0] for x in result.description]
    if sorted(columns) != names:
        return f"columns {names} against {sorted(columns)}"
    at = [columns.index(c) for c in names]
    want = sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=order)
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    for g, w in zip(got, want, strict=True):
        for name, a, b in zip(names, g, w, strict=True):
            if a != b:
                return f"{name}: {g} against {w}"
    return None
