import pytest

from tessera import catalog
from tests.oracle import compare, database

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_equals_its_sql(spark, con, key):
    compare(QUERIES[key](spark, SF), con, ORACLES[key])


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, key):
    df = QUERIES[key](spark, SF)
    rows = df.collect()
    assert rows and len(df.columns) == len(set(df.columns))
