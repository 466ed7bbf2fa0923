"""Every registered query against its SQL check, on the smallest test tables."""

import os

import pytest

import __spark_entry__ as driver
from tabscope.catalog import check_sql, spark_queries
from tests.oracle import connect, difference

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(spark_queries()))
def test_query(spark, db, name):
    frame = spark_queries()[name](spark, FOLDER)
    sql = check_sql().get(name)
    if sql is None:
        assert frame.count() > 0
    else:
        assert difference(frame, db, sql) is None
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_checks_belong_to_queries():
    assert set(driver.oracle_sql()) <= set(driver.queries()) >= set(spark_queries())


def test_entry(spark):
    assert driver.entry(spark).count() == 3
