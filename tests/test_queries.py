"""Every query with SQL gives the rows that DuckDB gives."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from meterglass.plans import slate


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def rows(df):
    df = df[sorted(df.columns)]

    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and np.isnan(v):
            return None
        if hasattr(v, "isoformat"):
            return str(v)[:10]
        return round(float(v), 5) if isinstance(v, float | np.floating) else v

    return sorted((tuple(map(plain, r)) for r in df.astype(object).itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(slate.ORACLE_SQL))
def test_same_as_sql(spark, duck, sf_dir, name):
    got, want = slate.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(slate.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == pytest.approx(y) if all(isinstance(v, int | float) for v in x) else x == y


def test_every_query_is_told(spark):
    import __spark_entry__

    assert set(slate.QUERIES) <= set(__spark_entry__.queries())
    assert "trend_bundle" in slate.QUERIES
