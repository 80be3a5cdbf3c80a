"""Runs a query on Spark and its SQL on DuckDB over the same tables and compares rows."""
from __future__ import annotations

import glob
import math
import os
from collections import Counter


def duck(sf_dir: str):
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p + ('/*.parquet' if os.path.isdir(p) else '')}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if hasattr(v, "is_finite"):
        return round(float(v), 6)
    return v


def compare(spark, c, fn, sql: str, sf_dir: str) -> str:
    """Empty if rows and column names agree, else what differs."""
    df = fn(spark, sf_dir)
    names = sorted(df.columns)
    own = Counter(tuple(plain(r[n]) for n in names) for r in df.collect())
    got = c.execute(sql)
    cols = [d[0] for d in got.description]
    if sorted(cols) != names:
        return f"columns {names} and {sorted(cols)}"
    ix = [cols.index(n) for n in names]
    other = Counter(tuple(plain(r[i]) for i in ix) for r in got.fetchall())
    if own == other:
        return ""
    return f"rows {sum(own.values())} and {sum(other.values())}; only Spark {list((own - other).items())[:3]}; only SQL {list((other - own).items())[:3]}"
