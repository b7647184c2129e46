"""Operators that SQL can express give DuckDB's rows."""

import pytest
from compare import connect, differences

from gristmill.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_as_sql(spark, sf_dir, name):
    assert differences(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.ORACLE[name]) == ""
