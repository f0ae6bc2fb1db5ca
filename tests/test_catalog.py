"""Every query of the engine with SQL gives the SQL's rows."""

from __future__ import annotations

import pytest

from tests.oracle import differences, tables
from tidemark.plans import registry as catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    return tables(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, con, sf_dir, name):
    assert differences(catalog.QUERIES[name](spark, sf_dir), con, catalog.SQL[name]) == ([], [])


def test_entry_has_a_query_for_each_sql():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())
