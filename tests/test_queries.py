"""Every query of the core against its SQL; those without SQL run and keep their schema."""

import compare
import pytest

from tidemark.plans import registry

SQL = registry.oracles()


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(name, spark, data, duck):
    query = registry.queries()[name]
    if name in SQL:
        assert compare.differences(spark, duck, data, query, SQL[name]) == ""
    else:
        assert query(spark, data).count() > 0


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
