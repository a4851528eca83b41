"""Comparison of queries with their SQL over the driver's smallest tables."""

import os

import duckdb
import pandas as pd

FOLDER = "/root/testdata/sf0.001"


def connect(folder=FOLDER):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in os.listdir(folder):
        con.execute(f"create view {p[:-8]} as select * from '{folder}/{p}'")
    return con


def normal(df: pd.DataFrame):
    df = df[sorted(df.columns)].astype(object)
    return sorted(map(repr, df.where(df.notna(), None).values.tolist()))


def same(spark, query, sql, folder=FOLDER):
    got, want = query(spark, folder).toPandas(), connect(folder).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)
