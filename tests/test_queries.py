"""Every registered query against its check SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

DIRECTORY = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(DIRECTORY)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    frame = entry.queries()[name](spark, DIRECTORY)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert frame.count() >= 0
    else:
        assert compare(frame, con, sql)[1] == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0
