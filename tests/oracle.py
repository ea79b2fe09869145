"""Runs a query in Spark and its SQL in DuckDB on the same tables."""

import decimal
import glob
import math
import os

DATA = "/root/testdata/sf0.001"


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows_of(spark, query, sql, data=DATA):
    import duckdb

    frame = query(spark, data)
    names = sorted(frame.columns)
    ours = sorted(repr([plain(r[c]) for c in names]) for r in frame.collect())
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    found = con.execute(sql)
    columns = [x[0] for x in found.description]
    order = [columns.index(c) for c in sorted(columns)]
    theirs = sorted(repr([plain(r[k]) for k in order]) for r in found.fetchall())
    return (names, ours), (sorted(columns), theirs)
