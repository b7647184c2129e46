"""Every plan with SQL gives DuckDB's rows; every other one runs."""

import pytest
from compare import connect, differences

import __spark_entry__ as entry
from gristmill.plans import CORE_ORACLE, CORE_QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(CORE_ORACLE))
def test_same_as_sql(spark, sf_dir, duck, name):
    assert differences(CORE_QUERIES[name](spark, sf_dir), duck, CORE_ORACLE[name]) == ""


@pytest.mark.parametrize("name", sorted(CORE_QUERIES.keys() - CORE_ORACLE.keys()))
def test_runs(spark, sf_dir, name):
    assert CORE_QUERIES[name](spark, sf_dir).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["p_partkey", "p_name", "p_type", "size", "p_retailprice"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
