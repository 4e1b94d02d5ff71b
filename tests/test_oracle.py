"""Every registered query against its SQL text, on the smallest tables.

The physical plan of each query is checked on the way: no pair joins, no
row-at-a-time Python, and windows only over keys whose groups are bounded.
"""

import re

import pytest

from codestrata.plans import catalogue
from oracle import compare, connect

SF = "/root/testdata/sf0.001"


# Bounded by one file, one service, one run's time buckets, one quota slot, or a rank limit.
WINDOW_KEYS = ({"project", "path"}, {"project", "path", "service"}, {"run_id"}, {"minute"}, {"day"}, {"conv_id"}, {"project"})


def check_plan(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert node not in plan
    for keys in re.findall(r"\n[^\n]*Window \[[^\n]*?\], \[([^\]]*?)\], \[", plan):
        names = {re.sub(r"#\d+L?$", "", k.strip()) for k in keys.split(",")}
        assert names in WINDOW_KEYS, names
        if names == {"project"}:
            assert "WindowGroupLimit" in plan


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, con, name):
    if name not in catalogue.ORACLES:
        assert catalogue.QUERIES[name](spark, SF).count() >= 0
        return
    error, rows = compare(spark, con, SF, catalogue.QUERIES[name], catalogue.ORACLES[name], check_plan)
    assert error is None, error


def test_entry(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
