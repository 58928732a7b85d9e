"""Every query against its SQL counterpart, on the smallest given tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as driver
from workload.oracle import ORACLE
from workload.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for file in sorted(os.listdir(SF_DIR)):
        name = file.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{file}'")
    return con


def comparable(rows):
    def plain(v):
        return None if isinstance(v, float) and math.isnan(v) else v

    return sorted(
        ([plain(v) for v in r] for r in rows), key=lambda r: [(v is None, str(v)) for v in r]
    )


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(ORACLE) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    found = QUERIES[name](spark, SF_DIR)
    expected = tables.execute(ORACLE[name])
    columns = [c[0] for c in expected.description]
    assert sorted(found.columns) == sorted(columns)
    got = comparable([r[c] for c in columns] for r in found.collect())
    assert got == comparable(expected.fetchall())


def test_entry(spark):
    assert driver.entry(spark).count() > 0
