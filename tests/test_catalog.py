import re

import __spark_entry__ as entry
from netquill.contract import FEATURE_COLUMNS


def test_contract_is_frozen():
    assert len(FEATURE_COLUMNS) == len(set(FEATURE_COLUMNS)) == 78


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150


def test_entry_plan_needs_no_python_worker(spark):
    df = entry.entry(spark)
    assert df.columns[-78:] == FEATURE_COLUMNS
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|CartesianProduct|BroadcastNestedLoopJoin", plan)
    assert "Scan" in plan and "html" not in plan  # only needed columns are read
