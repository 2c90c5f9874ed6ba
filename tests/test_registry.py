"""Every registered query against its SQL twin, and the shape of its plan."""

import os

import pytest

import __spark_entry__ as entry_point
from bizlens.registry import all_queries
from tests import oracle

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
ALL = all_queries()


@pytest.fixture(scope="module")
def con():
    return oracle.duck(FOLDER)


@pytest.mark.parametrize("name", list(ALL))
def test_query_equals_sql(spark, con, name):
    query, text = ALL[name]
    verdict, _ = oracle.compare(spark, con, FOLDER, query, text)
    assert verdict.startswith(("ok", "rows only")), verdict


PLANS = [
    "channel_scorecard", "rep_leaderboard", "customer_profit", "production_plan", "plan_what_if", "survival_curve", "funnel_step_rates",
    "measures_cross_fact", "signals_convergence", "prior_cancels", "text_entity_tags", "receivables", "plan_scenario_rows", "model_auc",
]


@pytest.mark.parametrize("name", PLANS)
def test_plan_has_no_cross_join_and_no_python(spark, capfd, name):
    ALL[name][0](spark, FOLDER).explain()
    plan = capfd.readouterr().out
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan


def test_filters_and_columns_reach_the_scan(spark, capfd):
    from bizlens.sources.warehouse import Warehouse

    Warehouse(spark, FOLDER).incoming().groupBy("product_key").sum("qty").explain("formatted")
    plan = capfd.readouterr().out
    assert "EqualTo(l_linestatus,O)" in plan and "l_extendedprice" not in plan


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
