"""Every registered query of the reference's operators against its SQL, at the smallest size."""

import pytest
from oracle import connect, rows_of, rows_of_sql

from tracewright.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_equals_sql(spark, con, name):
    assert rows_of(catalogue.QUERIES[name](spark, SF)) == rows_of_sql(con, catalogue.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    assert len(df.columns) == len(set(df.columns))
    df.collect()


def test_scan_has_one_exchange_for_windows(spark):
    plan = catalogue.QUERIES["window_suppressed_rules"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_filters_reach_the_scan(spark):
    plan = catalogue.QUERIES["previous_completed"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan
