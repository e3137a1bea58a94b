"""Every query with SQL gives what DuckDB gives on the smallest data."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from weft.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_parity(spark, duck, name):
    a, b = catalogue.QUERIES[name](spark, DATA).toPandas(), duck.execute(catalogue.SQL[name]).fetchdf()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    left, right = (sorted(tuple(map(plain, r)) for r in x[cols].astype(object).where(x[cols].notna(), None).values.tolist()) for x in (a, b))
    assert left == right


def test_entry_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
