"""A Spark result against DuckDB's, whatever the order of rows and columns."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    made = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        made.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return made


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def plain(v):
        if isinstance(v, (list, np.ndarray)):
            return tuple(plain(x) for x in v)
        if v is None or v is pd.NA or isinstance(v, float) and np.isnan(v):
            return None
        if isinstance(v, (np.integer, np.bool_)):
            return v.item()
        if isinstance(v, (float, np.floating)):
            return float(v)
        return v

    return sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False)), key=repr)


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)
