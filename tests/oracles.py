"""Compare a Spark query with its DuckDB oracle, both over whole tables."""

import glob
import math
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def connect():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    return None if isinstance(v, float) and math.isnan(v) else v


def compare(spark, query, sql):
    df = query(spark, DATA)
    r = connect().execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(df.columns) == sorted(names)
    cols = sorted(names)
    want = sorted((tuple(plain(row[names.index(c)]) for c in cols) for row in r.fetchall()), key=repr)
    got = sorted((tuple(plain(row[c]) for c in cols) for row in df.collect()), key=repr)
    assert got == want
