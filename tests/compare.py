"""Compare a Spark query with its SQL in DuckDB: columns, types and rows in any order."""

import glob
import os

import duckdb
import pandas as pd

DATA = "/root/testdata"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def connect(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def plain(v):
    if v is None or (not isinstance(v, (list, dict)) and pd.isna(v)):
        return None
    if isinstance(v, float):
        return int(v) if v.is_integer() else round(v, 9)
    return v


def rows(frame, columns):
    return sorted((tuple(plain(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False)), key=repr)


def same(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    con = connect(sf_dir)
    con.execute(f"create temp table want as {sql}")
    types = dict(con.execute("select column_name, data_type from information_schema.columns where table_name = 'want'").fetchall())
    assert {c: TYPES.get(k, k) for c, k in df.dtypes} == types
    columns = sorted(types)
    assert rows(df.toPandas(), columns) == rows(con.execute("from want").df(), columns)
