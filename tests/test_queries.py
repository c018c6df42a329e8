"""Every registered query against its SQL check on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import connect, difference, run_spark

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.fixture(scope="module")
def registered(spark):
    return entry.queries(), entry.oracle_sql()


def names():
    from pyspark import SparkContext
    from tests.conftest import session

    if SparkContext._active_spark_context is None:
        session()
    return sorted(entry.queries())


@pytest.mark.parametrize("name", names() if os.path.isdir(SF) else [])
def test_query(spark, con, registered, name):
    queries, checks = registered
    if name not in checks:
        assert run_spark(spark, queries[name], SF)[2] is not None
        return
    problem, _, _, _ = difference(spark, con, queries[name], checks[name], SF)
    assert problem is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
