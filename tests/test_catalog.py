"""The engine's queries against DuckDB on the same tables."""

import pytest

from millrace.plans import catalog, streams  # noqa: F401
from oracle import same


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, small, name):
    same(catalog.QUERIES[name](spark, small), catalog.SQL[name], small)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, small, name):
    assert catalog.QUERIES[name](spark, small).count() > 0
