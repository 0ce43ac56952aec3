import pytest
from oracle import connect, same

from sequora.plans import catalog

NO_ORACLE = sorted(set(catalog.QUERIES) - set(catalog.ORACLES))


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_oracle(spark, small, con, name):
    from sequora.session import ship

    ship(spark)
    same(catalog.QUERIES[name](spark, small), con, catalog.ORACLES[name])


@pytest.mark.parametrize("name", [n for n in NO_ORACLE if n not in ("coverage_sweep", "error_sweep", "consensus_nanopore")])
def test_has_rows(spark, small, name):
    df = catalog.QUERIES[name](spark, small)
    assert df.columns and df.count() >= 0


def test_entry_has_every_query(spark):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
