"""Every catalog query against its SQL over the same tables."""

import duckdb  # noqa: F401
import parity
import pytest

from sievework.plans import catalog, catalog_more, catalog_rows  # noqa: F401


@pytest.fixture(scope="module")
def con(small):
    return parity.duck(small)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, small, con, name):
    got = catalog.QUERIES[name](spark, small)
    cursor = con.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(got.columns) == sorted(names)
    assert parity.rows(got.columns, got.collect()) == parity.rows(names, cursor.fetchall())


def test_without_sql(spark, small):
    for name in sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)):
        assert catalog.QUERIES[name](spark, small).count() > 0


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalog.QUERIES) <= set(entry.queries())
    assert {r.disposition for r in entry.entry(spark).collect()} >= {"included"}
