"""The driver's correctness gate, locally: every registered query with an
oracle SQL must equal DuckDB's result on the sf0.01 tables."""

import pytest

import __spark_entry__ as entry
from conftest import TESTDATA
from oracle_check import compare, duck

SF = f"{TESTDATA}/sf0.01"
QUERIES = entry.queries()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, con, name, QUERIES[name], SQL[name], SF)
    assert res["ok"], res


def test_every_query_has_a_builder():
    assert set(SQL) <= set(QUERIES)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "plate" in df.columns and "numtrips" in df.columns
