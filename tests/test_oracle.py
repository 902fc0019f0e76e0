"""Every query with SQL gives the same rows as DuckDB; no query crosses tables."""

import pytest

import __spark_entry__ as entry_point
from oracle import connect, difference

QUERIES, ORACLES = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def duck(folder):
    connection = connect(folder)
    yield connection
    connection.close()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, folder, duck, name):
    df = QUERIES[name](spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert difference(df, duck, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.endswith(("report", "classifier")) and n not in ORACLES))
def test_reports_are_complete(spark, folder, name):
    df = QUERIES[name](spark, folder)
    rows = df.collect()
    assert rows
    if "row_name" in df.columns:
        assert {"NINN", "INN", "accuracy", "macro avg", "weighted avg"} <= {r.row_name for r in rows}


def test_entry(spark):
    assert entry_point.entry(spark).count() == 50
