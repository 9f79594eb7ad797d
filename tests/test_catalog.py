"""Every query with SQL, on whole tables, against DuckDB."""

import pytest
from compare import connection, difference

import __spark_entry__ as contract

SQL = contract.oracle_sql()
MODELS = {"model_roundtrip"}


@pytest.fixture(scope="module")
def duck(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(set(SQL) - MODELS))
def test_matches_sql(spark, sf, duck, name):
    assert difference(contract.queries()[name](spark, sf), duck, SQL[name]) is None


def test_every_sql_has_a_query():
    assert set(SQL) <= set(contract.queries())


def test_entry_runs(spark):
    assert contract.entry(spark).count() == 7


# The scenario is one constant load: its key folds to a literal, so one model row meets 31 days.
CONSTANT = {"scenario_rates", "scenario_check"}


@pytest.mark.parametrize("name", sorted(set(SQL) - MODELS - CONSTANT))
def test_no_row_pairing_joins(spark, sf, name):
    plan = contract.queries()[name](spark, sf)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_date_filter_and_columns_reach_the_scan(spark, sf):
    plan = contract.queries()["split_train"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(date,2000-01-01)" in plan
    assert "ReadSchema: struct<load_id:string,date:date,posted_rate:double>" in plan
