"""Every registered query of the library against its SQL, on the smallest tables."""

import math
import os

import pytest

from palisade.plans import catalogue

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def shown(v):
    return ("nan" if math.isnan(v) else repr(round(v, 6))) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, tables, name):
    got = catalogue.QUERIES[name](spark, DATA)
    want = tables.sql(catalogue.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted(tuple(shown(r[c]) for c in want.columns) for r in got.collect())
    assert rows == sorted(tuple(map(shown, r)) for r in want.fetchall())
