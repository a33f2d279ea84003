"""Each query with SQL against DuckDB on the smallest tables."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

from tesela import catalog

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, (decimal.Decimal, float)):
        return round(float(x), 6)
    if isinstance(x, datetime.datetime):
        return str(x)[:26].replace("+00:00", "")
    return None if str(x) in ("NaT", "<NA>") else x


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(repr(tuple(plain(v) for v in r)) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, con, name):
    assert rows(catalog.QUERIES[name](spark, DIR).toPandas()) == rows(con.sql(catalog.SQL[name]).df())


def test_every_query_has_rows_and_a_schema(spark):
    for name in set(catalog.QUERIES) - set(catalog.SQL):
        assert catalog.QUERIES[name](spark, DIR).columns
