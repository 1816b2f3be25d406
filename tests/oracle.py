"""Runs a query and its oracle over the same tables and compares the rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings rollouts records data_config annotations phases hier_events actions causal_links sample_targets pack_plans mix_targets".split()


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v:.6g}" if v else "0"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(str(norm(x)) for x in v) + "]"
    if isinstance(v, dict):
        return str({k: norm(x) for k, x in v.items()})
    return "" if v is None else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def compare(spark, con, sf_dir, fn, sql) -> str:
    """Empty if equal, else what differs."""
    df = fn(spark, sf_dir)
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = rows_of(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(cols)}"
    got = rows_of(df.columns, df.collect())
    if got == want:
        return ""
    a, b = set(got), set(want)
    return f"{len(got)} rows against {len(want)}; only here {list(a - b)[:4]}; only there {list(b - a)[:4]}"
