"""Every registered query with SQL against DuckDB on the smallest tables; those without SQL must run."""

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toArrow()
    if name in ORACLES:
        assert compare(got, con.execute(ORACLES[name]).to_arrow_table()) == []


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 1 and rows[0]["total_return"] is not None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
