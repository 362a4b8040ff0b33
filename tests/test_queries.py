"""Every query against its SQL in DuckDB, and that every query gives rows."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from inkflow.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def connect(folder):
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for name in os.listdir(folder):
        c.sql(f"create view {name.removesuffix('.parquet')} as select * from '{folder}/{name}'")
    return c


def frame(df):
    """Rows as sorted tuples of plain values, with None for nulls."""
    plain = lambda x: None if pd.isna(x) else x.item() if isinstance(x, np.generic) else x
    rows = [tuple(map(plain, row)) for row in df[sorted(df.columns)].astype(object).itertuples(index=False)]
    return sorted(rows, key=lambda r: [(x is None, x if x is not None else 0) for x in r])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLES:
        assert len(got)
        return
    want = connect(SF).sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert frame(got) == frame(want)
