"""Comparison of a query with its SQL in DuckDB, as multisets of rows."""

import glob
import os

import duckdb
import numpy as np


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def rows_of_sql(sql, sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted("|".join(plain(r[i]) for i in order) for r in got.fetchall())


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted("|".join(plain(r[n]) for n in names) for r in df.collect())
