"""Rows of both engines in one form."""

import glob
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(plain(v) for v in r) for r in df.select(*cols).collect())


def duck_rows(sql, sf_dir=None, tables=None):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet") if sf_dir else ():
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    for name, frame in (tables or {}).items():
        c.register(name, frame)
    r = c.sql(sql)
    cols = sorted(r.columns)
    at = [r.columns.index(x) for x in cols]
    return cols, sorted(tuple(plain(t[i]) for i in at) for t in r.fetchall())
