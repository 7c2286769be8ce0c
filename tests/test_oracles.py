"""Every query of the library that has SQL gives the rows that DuckDB gives; the others run."""

import pytest

from tests.compare import differences
from textquarry.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), sf_dir, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
