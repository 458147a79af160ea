"""Rows of Spark and DuckDB in one form."""

import datetime
import decimal
import glob
import math
import os


def plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 4)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(plain(x) for x in v) if isinstance(v, list) else v


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted([tuple(plain(r[c]) for c in cols) for r in df.collect()], key=lambda x: tuple(map(str, x)))


def sql_rows(con, sql):
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    cols = sorted(names)
    return cols, sorted([tuple(plain(dict(zip(names, x))[c]) for c in cols) for x in r.fetchall()], key=lambda x: tuple(map(str, x)))
