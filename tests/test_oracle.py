"""Every registered query of the contest domain against DuckDB on the same tables."""

import pytest
from oracle import compare, connection

from rallyframe import plans


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = plans.QUERIES[name](spark, sf_dir)
    if name in plans.ORACLES:
        assert compare(df, duck, plans.ORACLES[name]) is None
    else:
        df.collect()


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
