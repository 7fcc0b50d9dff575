"""Rows of a Spark query against rows of DuckDB SQL, whatever their order."""

import math
import os

import duckdb
import pandas as pd

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA:
        return None
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, bool):
        return x
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, int):
        return float(x)
    return x


def rows(frame: pd.DataFrame) -> list:
    columns = sorted(frame.columns)
    return sorted((tuple(plain(x) for x in r) for r in frame[columns].astype(object).itertuples(index=False)), key=repr)


def duck(sql: str, folder: str = DATA) -> pd.DataFrame:
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{name}'")
    return con.execute(sql).fetchdf()


def same(query, sql: str, spark, folder: str = DATA) -> None:
    ours, theirs = query(spark, folder).toPandas(), duck(sql, folder)
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
