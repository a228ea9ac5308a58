"""Runs a registered query and its SQL and compares the results value by value."""

from __future__ import annotations

import datetime
import math
import time
from pathlib import Path

import duckdb
import numpy as np

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, datetime.datetime):
        return v.date().isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i].lower())
    out = [tuple(_value(r[i]) for i in order) for r in rows]
    return [cols[i].lower() for i in order], sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark, con, name, fn, sql, sf_dir):
    """(ok, message)"""
    t0 = time.time()
    df = fn(spark, sf_dir)
    got_cols, got = df.columns, [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return True, f"{name}: {len(got)} rows, spark {t1 - t0:.1f}s, no SQL"
    cur = con.execute(sql)
    want_cols, want = [d[0] for d in cur.description], cur.fetchall()
    t2 = time.time()
    gc, g = _rows(got_cols, got)
    wc, w = _rows(want_cols, want)
    note = f"{name}: {len(g)} rows, spark {t1 - t0:.1f}s, duckdb {t2 - t1:.1f}s"
    if gc != wc:
        return False, f"{note}: columns {gc} != {wc}"
    if len(g) != len(w):
        return False, f"{note}: {len(g)} rows != {len(w)}"
    bad = [(a, b) for a, b in zip(g, w) if a != b]
    if bad:
        return False, f"{note}: {len(bad)} rows differ, first spark={bad[0][0]} sql={bad[0][1]}"
    return True, note
