"""Rows of a Spark query against DuckDB's rows for its SQL."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, float) and v == int(v):
        return str(int(v))
    return str(v)


def rows_of(frame, columns):
    return sorted((tuple(map(_cell, r)) for r in frame[columns].itertuples(index=False, name=None)), key=repr)


def duck(sql, data):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{data}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con.execute(sql).df()


def assert_same(df, sql, data):
    got, want = df.toPandas(), duck(sql, data)
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows_of(got, columns) == rows_of(want, columns)
