"""Compares a query with its oracle, as multisets of rows."""

from __future__ import annotations

import datetime
import decimal
import glob
import os
from collections import Counter

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, decimal.Decimal):
        return str(v.normalize())
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def same(spark, query, sql: str) -> tuple[Counter, Counter]:
    import duckdb

    db = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        db.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    df = query(spark, DATA)
    columns = sorted(df.columns)
    rows = Counter(repr(tuple(map(plain, r))) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    found = db.execute(sql)
    at = [[d[0] for d in found.description].index(c) for c in columns]
    return rows, Counter(repr(tuple(plain(r[i]) for i in at)) for r in found.fetchall())
