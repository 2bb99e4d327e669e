"""Compare a query's rows with those of its SQL in DuckDB."""

import os

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"


def connect(sf_dir=SF):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("float"):
            df[c] = df[c].round(6)
        df[c] = df[c].astype(object).where(df[c].notna(), None).map(lambda x: "<null>" if x is None else str(x)).str.replace(r"^(-?\d+)\.0$", r"\1", regex=True)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def assert_same(got, want):
    a, b = normal(got.toPandas()), normal(want)
    assert list(a.columns) == list(b.columns)
    assert len(a) == len(b)
    pd.testing.assert_frame_equal(a, b, check_dtype=False)
