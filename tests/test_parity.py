"""Every registered query against its SQL twin; those without one must run."""

from __future__ import annotations

import pytest

from fernweave import queries
from tests.parity import compare, oracle_connection

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle_connection(FOLDER)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    df = queries.all_queries()[name](spark, FOLDER)
    sql = queries.all_oracles().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert compare(con, df, sql) == []


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
