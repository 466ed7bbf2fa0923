"""The registered queries against their SQL checks, on the smallest test tables."""

import os

import pytest

import corpus_pipeline
from tabscope.llm import queries
from tests.oracle import connect, difference

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    frame = queries.QUERIES[name](spark, FOLDER)
    sql = queries.CHECKS.get(name)
    if sql is None:
        source = "pages" if name.startswith("op5") else "documents"
        assert frame.count() >= queries.table(spark, FOLDER, source).count()
    else:
        assert difference(frame, connect(FOLDER), sql) is None
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_there_is_a_query_for_each_operator():
    assert {int(n.split("_")[0][2:]) for n in queries.QUERIES} == set(range(1, 14))
    assert corpus_pipeline.ORACLE_SQL is None
