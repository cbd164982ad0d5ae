"""Every registered query of the library against its SQL, and those without SQL for rows and a stable schema."""

import pytest

from sediment.plans import registry

from .oracle import connected, same


@pytest.fixture(scope="module")
def db(sf):
    return connected(sf)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, sf, db, name):
    df = registry.QUERIES[name](spark, sf)
    if name in registry.ORACLE_SQL:
        same(df, db, registry.ORACLE_SQL[name])
    else:
        assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
