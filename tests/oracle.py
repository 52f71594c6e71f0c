"""Rows of a Spark query and of its SQL in DuckDB, brought to one form."""

import glob
import math
import os

import duckdb

DATA = "/root/testdata"


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if hasattr(v, "isoformat"):
        return (v.replace(tzinfo=None) if hasattr(v, "hour") else v).isoformat()
    return str(v)


def connect(sf):
    c = duckdb.connect()
    c.sql("set TimeZone='UTC'")
    for f in glob.glob(f"{DATA}/{sf}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(norm(r[k]) for k in cols) for r in df.collect())


def rows_of_sql(c, sql):
    r = c.sql(sql)
    cols = sorted(r.columns)
    at = [r.columns.index(k) for k in cols]
    return cols, sorted(tuple(norm(x[i]) for i in at) for x in r.fetchall())
