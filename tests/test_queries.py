"""Every query of the registry against its SQL, and the entry points."""

import pytest

import __spark_entry__
from tarn.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(registry.QUERIES[name], registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_has_rows(name, spark, sf):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry_points(spark):
    assert __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
