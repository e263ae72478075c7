"""Every registered query of the engine against its SQL at the smallest scale."""

import pytest

from graphloom.plans import registry
from tests.oracle import rows_of_spark, rows_of_sql


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, sf, name):
    assert rows_of_spark(registry.queries()[name](spark, sf)) == rows_of_sql(registry.oracle_sql()[name], sf)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["query_id", "pos", "hops", "line"]
    assert set(e.oracle_sql()) <= set(e.queries())
