"""Run a query and its SQL twin on the same tables and compare values."""

from __future__ import annotations

import decimal
import math
import os

import duckdb

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def duck(sf_dir: str = SF_DIR):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=repr)


def close(a, b, tol=2e-6):
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(close(x, y, tol) for x, y in zip(a, b))
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return a == b or abs(a - b) <= tol * max(1.0, abs(a), abs(b))
    return a == b


def diff(spark_df, sql, con):
    """None when equal, else a short description; second value: exact equality of all values."""
    rel = con.execute(sql)
    dcols, drows = rows_of([d[0] for d in rel.description], rel.fetchall())
    scols, srows = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if scols != dcols:
        return f"columns {scols} != {dcols}", False
    if len(srows) != len(drows):
        return f"rows {len(srows)} != {len(drows)}", False
    exact = srows == drows
    if exact:
        return None, True
    bad = [(a, b) for a, b in zip(srows, drows) if not close(a, b)]
    if bad:
        cells = [(c, x, y) for c, x, y in zip(scols, *bad[0]) if not close(x, y)]
        return f"{len(bad)} of {len(srows)} rows differ; first: {cells[:6]}", False
    return None, False
