"""Every registered query against its SQL twin; without one, that it runs."""

import pytest

import checks
from checks.compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(checks.QUERIES))
def test_query(spark, con, name):
    df = checks.QUERIES[name](spark, SF)
    if name in checks.ORACLES:
        result = compare(df, con, checks.ORACLES[name])
        assert result.startswith("ok"), result
    else:
        assert df.count() >= 0
    spark.catalog.clearCache()


def test_flagship_reads_the_supplied_tables(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())
