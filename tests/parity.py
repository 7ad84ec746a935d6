"""Compare a query with its SQL on the checking engine, by column names, kinds and rows."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF_DIR = os.environ.get("PARITY_SF_DIR", "/root/testdata/sf0.001")


def connection(sf_dir: str = SF_DIR) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else x + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, datetime.date):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if isinstance(x, (bytes, bytearray)):
        return bytes(x).hex()
    return x


def sorted_rows(rows) -> list:
    return sorted((tuple(plain(v) for v in r) for r in rows), key=lambda r: tuple((v is None, str(type(v)), v) if not isinstance(v, (int, float)) or isinstance(v, bool) else (False, "n", v) for v in r))


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def differences(df, con, sql: str, limit: int = 5) -> str:
    """Empty if equal."""
    rel = con.sql(sql)
    names = sorted(df.columns)
    if names != sorted(rel.columns):
        return f"columns {names} and {sorted(rel.columns)}"
    kinds = dict(zip(rel.columns, map(str, rel.types)))
    odd = {c: (k, kinds[c]) for c, k in df.dtypes if k in KINDS and KINDS[k] != kinds[c]}
    ours = sorted_rows(df.select(*names).collect())
    theirs = sorted_rows(rel.select(*[f'"{n}"' for n in names]).fetchall())
    if odd:
        return f"kinds {odd}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} and {len(theirs)}; only ours {[r for r in ours if r not in set(theirs)][:limit]}; only theirs {[r for r in theirs if r not in set(ours)][:limit]}"
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(bad)} of {len(ours)} rows differ: {names} {bad[:limit]}" if bad else ""
