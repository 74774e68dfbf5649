"""Holds a Spark result against DuckDB SQL over the same tables."""

import datetime
import decimal
import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
        return None
    if isinstance(v, (pd.Timestamp, datetime.datetime)):
        return v.strftime("%Y-%m-%d %H:%M:%S")
    if isinstance(v, datetime.date):
        return v.strftime("%Y-%m-%d 00:00:00")
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, float, np.integer, np.floating, decimal.Decimal)):
        return float(v)
    return v


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(str([plain(x) for x in r]) for r in frame.itertuples(index=False, name=None))


def duck(sql, folder):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con.sql(sql).df()


def assert_same(df, sql, folder):
    ours, theirs = df.toPandas(), duck(sql, folder)
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
