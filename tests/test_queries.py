"""Every core query against its SQL, on the smallest tables."""

import pytest
from compare import check

import __spark_entry__ as entry
from wayfold.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, tables, name):
    check(spark, registry.QUERIES[name], registry.SQL[name], tables)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, tables, name):
    assert registry.QUERIES[name](spark, tables).columns


def test_entry(spark, tables):
    df = entry.entry(spark)
    assert df.columns == ["state", "customers", "moves"] and df.count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(registry.QUERIES) > 100
