"""Every query against its SQL on the smallest table."""

import glob
import os

import duckdb
import pytest

from sessionloom.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, db, name):
    a, b = QUERIES[name](spark, DIR).toPandas(), db.sql(ORACLES[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    rows = lambda x: sorted(map(str, x[sorted(a.columns)].astype(object).where(x[sorted(a.columns)].notna(), None).itertuples(index=False, name=None)))
    assert rows(a) == rows(b)
