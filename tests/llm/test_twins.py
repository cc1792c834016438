"""What SQL can say of the operators, against DuckDB."""

import pytest
from compare import compare, views

from factloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_its_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), views(SF), queries.ORACLE_SQL[name]) is None
