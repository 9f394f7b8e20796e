"""Every registered query against its DuckDB twin."""

from functools import cache

import pytest

import __spark_entry__ as driver
from catalog import queries_matrix as qm
from tests.compare import connect, difference

ORACLE = driver.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.fixture(scope="module")
def shared_matrix():
    """Report queries share one staged matrix; its own queries are run whole."""
    patch = pytest.MonkeyPatch()
    patch.setattr(qm, "_raw_matrix", cache(qm._raw_matrix))
    patch.setattr(qm, "_matrix", cache(qm._matrix))
    yield
    patch.undo()


@pytest.mark.parametrize("name", sorted(driver.queries()))
def test_query(spark, sf, con, shared_matrix, name):
    df = driver.queries()[name](spark, sf)
    if name in ORACLE:
        assert difference(df, con, ORACLE[name]) is None
    else:
        assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(driver.queries())


def test_entry(spark):
    assert driver.entry(spark).count() > 0
