"""Compares a query with its SQL in DuckDB on the same tables."""

import glob
import math
import os

import duckdb


def views(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def cell(x):
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    return int(x) if hasattr(x, "__int__") and not hasattr(x, "year") and float(x) == int(x) else x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr)


def both(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = views(sf_dir).execute(sql)
    other = rows([x[0] for x in cur.description], cur.fetchall())
    return mine, other
