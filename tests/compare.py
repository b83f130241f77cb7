"""Order-free comparison of a Spark result with DuckDB's on the same tables."""

from __future__ import annotations

import os

import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def _cell(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return round(float(v), 6) + 0.0
    return v


def rows(df: pd.DataFrame) -> list[tuple]:
    return sorted((tuple(map(_cell, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=str)


def same(spark_df, con, sql: str) -> None:
    got, want = spark_df.toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    assert [x for x in zip(a, b, strict=True) if x[0] != x[1]][:3] == []
