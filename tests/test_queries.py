"""Every query runs; every query with SQL gives exactly the rows, names and types of its SQL."""

from __future__ import annotations

import pytest
from compare import connect, differences

import __spark_entry__ as entry_points
from oracles.sql import ORACLES
from tillwise.plans.catalogue import QUERIES


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", ORACLES)
def test_same_as_sql(spark, data, con, name):
    assert differences(QUERIES[name](spark, data), con, ORACLES[name]) == []


def test_sql_names_are_queries():
    assert set(ORACLES) <= set(QUERIES) <= set(entry_points.queries())
    assert set(ORACLES) <= set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, data, name):
    rows = QUERIES[name](spark, data).collect()
    assert rows


def test_entry(spark):
    assert entry_points.entry(spark).count() == 6
