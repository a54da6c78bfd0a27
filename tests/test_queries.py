"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import connect, difference
from conftest import SF

import __spark_entry__ as entry
from roadlog.plans import registry

QUERIES, ORACLES = registry.QUERIES, registry.ORACLES
WITHOUT_SQL = {"spline_resample", "spline_by_length", "encroachment"}      # tested against brute force in test_brute_force


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_entry_has_all_queries():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_every_query_but_the_listed_has_sql():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL
    assert set(ORACLES) <= set(QUERIES)


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, ORACLES[name]) is None


def test_twins_are_cut(spark):
    from roadlog.operators.ordered import chunk_width, row_limit

    log = registry.messages(spark, "/root/testdata/sf0.01")
    assert chunk_width(log, ["run_id"], "t") is None
    with row_limit(20):
        assert chunk_width(log, ["run_id"], "t") is not None
