"""Every registered query that has SQL gives the SQL's rows, as DuckDB computes them on the same tables."""

import os
from decimal import Decimal

import duckdb
import numpy as np
import pandas as pd
import pytest

from visitlens import registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def cell(x):
    if x is None or (not isinstance(x, (list, dict, np.ndarray)) and pd.isna(x)):
        return "null"
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (int, float, Decimal, np.number)):
        return f"{float(x) + 0.0:.6g}"
    if isinstance(x, (list, np.ndarray)):
        return str([cell(y) for y in x])
    return str(pd.Timestamp(x)) if hasattr(x, "year") else str(x)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(cell(x) for x in r) for r in df.itertuples(index=False, name=None))


def same(a, b):
    if a == b:
        return True
    try:
        return bool(np.isclose(float(a), float(b), rtol=1e-5, atol=1e-9))
    except ValueError:
        return False


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF_DIR).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    assert all(same(x, y) for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    assert len(df.toPandas().columns) == len(df.columns)
