"""Comparison of a query with its SQL oracle: rows, columns and values, whatever their order."""

import glob
import math
import os

import duckdb


def connect(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def tidy(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return round(float(v), 6)
    return v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(tidy(r[i]) for i in order) for r in found), key=repr)


def same(df, con, sql):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = result.fetchall()
    mine = [tuple(r) for r in df.collect()]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, mine) == rows(names, theirs)
