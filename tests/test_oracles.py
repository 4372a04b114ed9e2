"""Every core query against its SQL on the smallest tables, as the driver compares them."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from marlstone.plans import cases, problems, reference

QUERIES = {**reference.QUERIES, **cases.QUERIES, **problems.QUERIES}
ORACLES = {**reference.ORACLE_SQL, **cases.ORACLE_SQL, **problems.ORACLE_SQL}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def normal(df):
    df = df[sorted(df.columns)]
    def one(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
            return "NULL"
        return f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(one, r)) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, duck, name):
    a, b = QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert normal(a) == normal(b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_run(spark, sf, name):
    QUERIES[name](spark, sf).collect()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
