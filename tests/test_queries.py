"""Every query of the engine against its SQL on the smallest tables."""

import pytest
from compare import same

from cubewright import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, duck, data, name):
    df = registry.QUERIES[name](spark, data)
    same(df.collect(), df.columns, duck.execute(registry.ORACLE_SQL[name]))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
