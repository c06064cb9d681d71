"""Every query against its SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest
from strandwise import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


def plain(df):
    df = df[sorted(df.columns)].copy()
    show = lambda v: "NULL" if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else repr(round(v, 6)) if isinstance(v, float) else str(v)
    for c in df.columns:
        df[c] = df[c].map(show)
    return list(df.columns), sorted(map(tuple, df.values.tolist()))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), con.execute(registry.ORACLE_SQL[name]).df()
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_has_rows(spark, name):
    assert registry.QUERIES[name](spark, DATA).limit(1).count() == 1
