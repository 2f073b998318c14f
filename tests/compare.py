"""Rows of a query against those of its SQL in another engine."""

from __future__ import annotations

import datetime
import decimal
import os

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def value(x):
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return repr(x)
    if isinstance(x, (float, decimal.Decimal)):
        return f"{float(x):.9g}"
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return repr(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i].lower())
    return [columns[i].lower() for i in order], sorted(tuple(value(r[i]) for i in order) for r in data)


def engine(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def difference(df, c, sql):
    """None, or how the two differ."""
    found = c.execute(sql)
    want = rows([d[0] for d in found.description], found.fetchall())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if got == want:
        return None
    if got[0] != want[0]:
        return f"columns {got[0]} / {want[0]}"
    a, b = set(got[1]), set(want[1])
    return f"{len(got[1])} / {len(want[1])} rows; only here {sorted(a - b)[:2]}; only there {sorted(b - a)[:2]}"
