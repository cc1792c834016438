import pytest
from compare import compare, views

from factloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return views(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLE_SQL:
        assert compare(df, con, catalog.ORACLE_SQL[name]) is None
    else:
        assert df.columns and df.count() >= 0
