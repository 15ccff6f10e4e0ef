"""Every query that has a SQL equivalent returns its rows."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from tests.conftest import TESTDATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{TESTDATA}/{t}.parquet')")
    return c


def plain(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(map(plain, x))
    if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, (int, float, np.number)) and not isinstance(x, bool):
        return repr(round(float(x), 5) + 0.0)
    return str(x)


def rows(d):
    return sorted(tuple(map(plain, r)) for r in d[sorted(d.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, duck, sf_dir, name):
    got = entry.queries()[name](spark, sf_dir).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
