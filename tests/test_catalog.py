import pytest
from compare import assert_same

from tessera import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(name, spark, sf_dir, duck):
    assert_same(catalog.QUERIES[name](spark, sf_dir), duck, catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(name, spark, sf_dir):
    df = catalog.QUERIES[name](spark, sf_dir)
    assert df.columns and df.count() >= 0


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(catalog.QUERIES) <= set(e.queries())
