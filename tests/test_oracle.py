"""Every registered query agrees with its SQL on the smallest data set."""

import os

import pytest

import __spark_entry__ as entry_point
from tools import check

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return check.duck(SF)


@pytest.mark.parametrize("name", list(entry_point.queries()))
def test_query(spark, con, name):
    fn, sql = entry_point.queries()[name], entry_point.oracle_sql().get(name)
    status, n, _, _ = check.compare(con, spark, SF, name, fn, sql)
    assert status in ("ok", "rows"), status
    if sql is None:
        assert n > 0


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


def test_names():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
