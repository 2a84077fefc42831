"""A query's rows against its SQL's rows in DuckDB."""

import os

import duckdb
import numpy as np
import pandas as pd

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(data=DATA):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{data}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, np.generic):
        v = v.item()
    if v is None or v is pd.NA or isinstance(v, float) and np.isnan(v):
        return None
    if isinstance(v, float):
        # A column of whole numbers and nulls comes as floats from one side.
        return int(v) if v.is_integer() else round(v, 6) + 0.0
    if hasattr(v, "__len__") and not isinstance(v, str | bytes | dict):
        return [plain(x) for x in v]
    return v


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(repr([plain(v) for v in r]) for r in df.itertuples(index=False))


def check(spark, query, sql, data=DATA):
    got, want = query(spark, data).toPandas(), connect(data).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
