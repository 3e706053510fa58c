"""Compares a query with its SQL: columns, rows and values, whatever their order."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(df: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
            return "null"
        if isinstance(x, bool) or type(x).__name__ == "bool_":
            return str(bool(x))
        if isinstance(x, float) or type(x).__name__.startswith("float"):
            return f"{float(x):.6g}"
        if type(x).__name__ == "Timestamp":
            return str(x.to_pydatetime())
        if type(x).__name__.startswith(("int", "uint")):
            return f"{float(x):.6g}" if abs(x) < 1e6 else str(int(x))
        return str(x)

    df = df.reindex(sorted(df.columns), axis=1)
    return sorted(tuple(map(cell, r)) for r in df.itertuples(index=False))


def assert_same(spark_df, sql: str, connection) -> None:
    got, want = spark_df.toPandas(), connection.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
