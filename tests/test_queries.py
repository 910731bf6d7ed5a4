"""Every registered query of the reference's operators against its oracle SQL."""

from __future__ import annotations

import pytest

from weftgraph import queries

from .oracle import connect, differences

SF = "/root/testdata/sf0.001"
# One rule each of what lint_all covers.
SINGLE_RULES = {f"lint_{r}" for r in queries.RULES}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(set(queries.ORACLE) - SINGLE_RULES))
def test_oracle(spark, con, name):
    assert differences(queries.REGISTRY[name](spark, SF), con, queries.ORACLE[name]) == ""
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", sorted(set(queries.REGISTRY) - set(queries.ORACLE)))
def test_runs(spark, name):
    assert queries.REGISTRY[name](spark, SF).count() > 0
    spark.catalog.clearCache()


def test_entry_imports_and_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
