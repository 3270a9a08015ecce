"""Comparison of a Spark result with DuckDB SQL over the same tables."""

import os

import duckdb
import pandas as pd


def connection(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        p = f"{sf_dir}/{f}"
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    cell = lambda v: None if v is None or v != v or v is pd.NaT else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted((tuple(map(cell, r)) for r in df.itertuples(index=False)), key=repr)


def assert_same(spark_df, connection, sql):
    got, want = spark_df.toPandas(), connection.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
