import pytest

from protolake import queries as core
from tests.compare import SF, assert_same


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_query_matches_sql(spark, name):
    assert_same(spark, core.QUERIES[name], core.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert core.QUERIES[name](spark, SF).count() > 0


def test_entry_gives_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
