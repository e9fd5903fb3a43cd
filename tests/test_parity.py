"""Every registered query of the engine against its SQL, or, without any, against its invariants."""

from __future__ import annotations

import pytest

from marlspark.plans import registry

from .parity import connection, same

ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, sf_dir, con, name):
    same(registry.queries()[name](spark, sf_dir), con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(ORACLES)))
def test_runs_and_repeats(spark, sf_dir, name):
    df = registry.queries()[name]
    assert df(spark, sf_dir).columns == df(spark, sf_dir).columns
    assert df(spark, sf_dir).count() >= 0


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 20
    assert set(e.oracle_sql()) <= set(e.queries())
