"""Every query against its SQL on the smallest test tables."""

import pytest

from helpers import DATA, rows_of, sql_rows
from quillon.queries import QUERIES, SQL

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, str(DATA))
    names, want = sql_rows(SQL[name])
    assert sorted(df.columns) == names
    assert rows_of(df) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_universe_plan_shares_one_exchange_and_broadcasts_metadata(spark):
    plan = QUERIES["universe"](spark, str(DATA))._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "BroadcastHashJoin" in plan and "LeftOuter" not in plan
    assert plan.count("hashpartitioning(ticker") <= 2 and plan.count("hashpartitioning(date") == 1
