"""Every registered query against its oracle, and the shape of its plan."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_module
from comparing import differences, oracle_connection
from martloom.catalog.oracle import all_oracles
from martloom.catalog.queries import MODELS, all_queries

ORACLES = all_oracles()
QUERIES = all_queries()
FORBIDDEN = (
    "CartesianProduct",
    "BroadcastNestedLoopJoin",
    "BatchEvalPython",
    "ArrowEvalPython",
    "MapInPandas",
)


@pytest.fixture(scope="module")
def oracle(small_dir):
    return oracle_connection(small_dir)


def test_every_query_has_an_oracle_except_models():
    assert set(QUERIES) - set(ORACLES) == set(MODELS)
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, small_dir, oracle, name):
    df = QUERIES[name](spark, small_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [word for word in FORBIDDEN if word in plan]
    assert differences(df, oracle, ORACLES[name]) == []


def test_entry_runs(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0
    assert set(entry_module.queries()) >= set(QUERIES)
    assert set(entry_module.oracle_sql()) >= set(ORACLES)
