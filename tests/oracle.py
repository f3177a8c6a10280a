"""Comparison of a query with its DuckDB SQL over the same tables: names, row counts and values, in any order."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    con.sql("set enable_progress_bar = false")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, (int, float)):
        v = 0.0 if abs(v) < 5e-7 else v
        return (2, f"{float(v):.6g}" if isinstance(v, float) and not float(v).is_integer() else str(int(v)))
    return (3, str(v))


def differences(df, con, sql):
    """What differs, as text; empty if nothing does."""
    rel = con.sql(sql)
    names = sorted(df.columns)
    if names != sorted(rel.columns):
        return f"columns {names} and {sorted(rel.columns)}"
    ours = sorted(tuple(_plain(r[n]) for n in names) for r in df.collect())
    at = [rel.columns.index(n) for n in names]
    theirs = sorted(tuple(_plain(r[i]) for i in at) for r in rel.fetchall())
    if len(ours) != len(theirs):
        return f"{len(ours)} rows and {len(theirs)}"
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(bad)} of {len(ours)} rows: {bad[:2]}" if bad else ""
