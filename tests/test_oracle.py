"""Every query with SQL against DuckDB."""

import pytest

from tidewell.plans import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf, duck, same, name):
    same(registry.queries()[name](spark, sf).toPandas(), duck(sf).sql(registry.oracle_sql()[name]).df())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 3
    assert set(e.oracle_sql()) <= set(e.queries())
