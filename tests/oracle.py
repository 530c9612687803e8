"""Comparison of a Spark result with DuckDB's answer to the oracle SQL."""

import datetime
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(map(cell, v))
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(cell(r[k]) for k in order) for r in rows), key=repr)


def compare(df, con, sql):
    """(difference or None): names, number of rows and values, whatever the order."""
    got_names = df.columns
    cur = con.execute(sql)
    want_names = [d[0] for d in cur.description]
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} and {sorted(want_names)}"
    got, want = rows_of(got_names, df.collect()), rows_of(want_names, cur.fetchall())
    if got != want:
        k = next((k for k, (a, b) in enumerate(zip(got, want)) if a != b), min(len(got), len(want)))
        return f"{len(got)} and {len(want)} rows; at {k}: {got[k : k + 2]} and {want[k : k + 2]} of {sorted(got_names)}"
    return None
