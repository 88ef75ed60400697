"""Every registered query of the engine gives the rows of its SQL."""

from __future__ import annotations

import pytest

from quire.plans import catalog
from tests.oracle import database, rows_of_spark, rows_of_sql

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_its_sql(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
        return
    names, expected = rows_of_sql(con, sql)
    got_names, got = rows_of_spark(df)
    assert got_names == names
    assert got == expected


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
