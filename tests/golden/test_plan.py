"""The published production plan, recomputed from its inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from bizlens.operators.quality import assert_anchors
from bizlens.plans import planning
from tests.conftest import rows

# Product, expected sales, stock, incoming, ending stock, need, status, lot target.
GOLDEN = [
    ("VAR-A", 400.00, 1200.03, 143.00, 943.03, 0.00, "green", None),
    ("VAR-B", 300.00, 297.48, 50.00, 47.48, 0.00, "red", None),
    ("VAR-C", 300.00, 115.85, 50.00, -134.15, 134.15, "red", 150),
    ("VAR-D", 200.00, 2433.52, 50.00, 2283.52, 0.00, "green", None),
    ("VAR-E", 482.46, 350.58, 0.00, -131.88, 131.88, "red", 150),
    ("VAR-F", 442.63, 138.55, 100.00, -204.08, 204.08, "red", 250),
    ("VAR-G", 587.32, 653.90, 50.00, 116.58, 0.00, "green", None),
    ("VAR-H", 146.62, 108.57, 100.00, 61.95, 0.00, "red", None),
    ("VAR-I", 272.81, 357.96, 100.00, 185.15, 0.00, "green", None),
    ("VAR-J", 507.84, 371.79, 50.00, -86.05, 86.05, "red", 150),
    ("VAR-K", 198.16, 171.51, 100.00, 73.35, 0.00, "red", None),
    ("VAR-L", 510.37, 488.93, 0.00, -21.44, 21.44, "red", 150),
    ("VAR-M", 474.21, 296.59, 0.00, -177.62, 177.62, "red", 200),
    ("VAR-N", 544.42, 617.41, 100.00, 172.99, 0.00, "green", None),
    ("VAR-O", 181.21, 137.73, 0.00, -43.48, 43.48, "red", 150),
    ("VAR-P", 160.23, 163.38, 0.00, 3.15, 0.00, "red", None),
    ("VAR-Q", 467.28, 635.97, 0.00, 168.69, 0.00, "green", None),
    ("VAR-Y", 0.00, 12.00, 0.00, 12.00, 0.00, "stopped", None),
    ("VAR-Z", 0.00, 12.00, 0.00, 12.00, 0.00, "stopped", None),
]


@pytest.fixture(scope="module")
def inputs(make):
    params = make([(k, k, s != "stopped", 100.0, None, None) for k, *_, s, _ in GOLDEN],
                  "product_key string, variety_name string, active boolean, red_threshold double, safety_floor double, safety_months double")
    forecast = make([(k, "26/27", c, q) for k, sales, *_ in GOLDEN if sales for c, q in (("direct", round(sales - 50, 2)), ("partner", 50.0))],
                    "product_key string, sales_year string, channel string, qty double")
    stock = make([(k, d, q) for k, _, held, *_ in GOLDEN for d, q in ((dt.date(2026, 1, 1), 999.0), (dt.date(2026, 3, 1), held))],
                 "product_key string, as_of_date date, qty double")
    incoming = make([(k, dt.date(2026, m, 1), q / 2) for k, _, _, q, *_ in GOLDEN if q for m in (5, 6)], "product_key string, arrival_date date, qty double")
    return params, forecast, stock, incoming


@pytest.fixture(scope="module")
def plan(inputs):
    return planning.production_plan(*inputs, include_stopped=True).cache()


def test_every_row_equals_the_golden_plan(plan):
    got = {r["product_key"]: (r["expected_sales"], r["stock_on_hand"], r["incoming"], r["ending_stock"], r["production_need"], r["status"]) for r in plan.collect()}
    assert got == {k: (s, h, i, e, n, st) for k, s, h, i, e, n, st, _ in GOLDEN}


def test_headline(plan):
    assert rows(planning.headline(plan)) == [(799.0, 11, 7, 17)]


def test_lot_targets(plan):
    got = {r["product_key"]: r["plan_target"] for r in planning.lot_size(plan).collect()}
    assert got == {k: t for k, *_, t in GOLDEN if t}


def test_stopped_rows_only_on_request(inputs):
    assert planning.production_plan(*inputs).filter("status = 'stopped'").count() == 0


def test_no_channel_mismatch(plan, inputs):
    assert planning.channel_mismatches(plan, inputs[1]).count() == 0
    broken = inputs[1].filter("not (product_key = 'VAR-C' and channel = 'partner')")
    assert rows(planning.channel_mismatches(plan, broken), "product_key") == [("VAR-C",)]


def test_anchor_gate(plan, make):
    anchors = make([("VAR-A", 943.03, "green", 0.0), ("VAR-B", 47.48, "red", 0.0), ("VAR-C", -134.15, "red", 134.15), ("VAR-D", 2283.52, "green", 0.0)],
                   "product_key string, ending_stock double, status string, production_need double")
    assert assert_anchors(plan, anchors, "product_key").count() == 0
    moved = plan.withColumn("ending_stock", F.col("ending_stock") + F.when(F.col("product_key") == "VAR-B", 0.02).otherwise(0.0))
    assert rows(assert_anchors(moved, anchors, "product_key"), "product_key", "field") == [("VAR-B", "ending_stock")]


def test_at_risk_actions(plan):
    got = {r["product_key"]: r["action"] for r in planning.at_risk(plan).collect()}
    assert got["VAR-C"] == "produce now" and got["VAR-B"] == "watch" and "VAR-A" not in got
