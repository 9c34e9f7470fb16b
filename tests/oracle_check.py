"""Compare a registered query with its SQL oracle on the same tables."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        path = Path(directory) / f"{table}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 4) + 0.0
    if isinstance(value, decimal.Decimal):
        return round(float(value), 4) + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, list):
        return tuple(_plain(v) for v in value)
    return value


def _kind(value):
    return "number" if isinstance(value, (int, float)) and not isinstance(value, bool) else type(value).__name__


def _sorted(rows):
    return sorted(rows, key=lambda r: [("", "") if v is None else (_kind(v), v if not isinstance(v, bool) else int(v)) for v in r])


def spark_rows(df):
    names = sorted(df.columns)
    return names, _sorted([tuple(_plain(r[n]) for n in names) for r in df.select(names).collect()])


def duck_rows(con, sql):
    result = con.execute(sql)
    found = [c[0] for c in result.description]
    names = sorted(found)
    rows = result.fetchall()
    return names, _sorted([tuple(_plain(r[found.index(n)]) for n in names) for r in rows])


def differences(left, right, limit=5):
    """First few differing rows; every value must be equal after rounding."""
    return [(a, b) for a, b in zip(left, right) if a != b][:limit]
