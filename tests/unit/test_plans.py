import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from bizlens.plans import channel, finance, funnel, loss, planning, retention, scorecard, segments, velocity
from tests.conftest import rows

DEAL = "deal_key int, company_key int, channel_key string, is_won int, is_lost int, mrr_usd double, dialer_hours double, deal_age_days int, retained_months int, is_churned int, churned_mrr double"


def deal(key, ch="c", won=1, mrr=10.0, hours=0.0, days=5, kept=12, churned=0):
    won, churned = int(won), int(churned)
    return (key, key, ch, won, 1 - won, mrr if won else 0.0, hours, days if won else None, kept if won else None, churned if won else 0, mrr if churned and won else 0.0)


@pytest.fixture(scope="module")
def dim(make):
    return make([("c", "C", "G", 0), ("d", "D", "G", 1)], "channel_key string, channel_name string, channel_group string, is_dialer_motion int")


def test_funnel_on_a_hand_counted_week(make):
    calls = make([(1, 1, 1), (2, 1, 0), (3, 0, 0), (4, 1, 1)], "call_key int, is_connected int, is_meeting_booked int")
    meetings = make([(1, "Held"), (2, "Cancelled")], "deal_key int, meeting_status string")
    deals = make([(1, 1), (2, 0)], "deal_key int, is_won int")
    assert [r["records"] for r in funnel.waterfall(calls, meetings, deals).orderBy("step_order").collect()] == [4, 3, 2, 1, 1]
    assert rows(funnel.step_rates(calls, meetings, deals)) == [(75.0, 66.67, 50.0, 100.0, 25.0)]
    none = calls.filter("call_key < 0")
    assert rows(funnel.step_rates(none, meetings, deals), "connect_rate_pct", "overall_win_rate_pct") == [(None, None)]


def test_leaderboard_fan_out_and_missing_deals(make):
    rep = make([("r1", "A", "t"), ("r2", "B", "t"), ("r3", "C", "t")], "rep_key string, rep_name string, rep_team string")
    calls = make([("r1", 1, 1), ("r1", 0, 0), ("r2", 1, 0), ("r2", 1, 0)], "rep_key string, is_connected int, is_meeting_booked int")
    deals = make([("r1", 1, 5.0), ("r1", 1, 6.0), ("r1", 0, 0.0)], "rep_key string, is_won int, mrr_usd double")
    got = funnel.rep_leaderboard(rep, calls, deals, min_calls=2)
    assert rows(got, "rep_key", "total_calls", "deals_won", "won_mrr_usd", "meeting_rate_pct") == [("r1", 2, 2, 11.0, 50.0), ("r2", 2, 0, 0.0, 0.0)]


def test_trap_counts_a_deal_once_with_two_meetings(make, dim):
    deals = make([deal(1), deal(2, won=0), deal(3, "d")], DEAL)
    meetings = make([(1, "Held"), (1, "Cancelled"), (2, "Held"), (3, "Held")], "deal_key int, meeting_status string")
    got = channel.trap(deals, meetings, dim, "C")
    assert rows(got, "deals", "won", "cancelled", "win_rate_pct", "cancel_rate_pct") == [(2, 1, 1, 50.0, 50.0)]


def test_segments_all_won_none_won(make):
    deals = make([(1, 1, 1, 0, 5.0), (2, 1, 1, 0, 7.0), (3, 2, 0, 1, 0.0)], "deal_key int, company_key int, is_won int, is_lost int, mrr_usd double")
    company = make([(1, "6-20", "X"), (2, "1-5", "Y")], "company_key int, employee_band string, industry string")
    assert rows(segments.win_rate(deals, company, ["industry"]), "industry", "win_rate_pct", "avg_won_mrr_usd") == [("X", 100.0, 6.0), ("Y", 0.0, None)]
    meetings = make([(1, "Held"), (2, "Cancelled"), (3, "Held")], "deal_key int, meeting_status string")
    held = segments.held(deals, meetings)
    assert rows(segments.lift(held, company, "employee_band", "6-20"), "segment_rate", "rest_rate", "lift_points") == [(1.0, 0.0, 0.5)]
    assert rows(segments.combined(held, company, "industry", ["Y", "Z"])) == [(1, 0, 0.0)]


def test_rep_spread(make):
    data = [("a", 1), ("a", 1), ("b", 1), ("b", 0), ("c", 0), ("c", 1), ("c", 0), ("c", 0), ("d", 0)]
    df = make([(ord(k), w) for k, w in data], "rep int, is_won int")
    assert rows(segments.spread(df, "rep"), "members", "top_key", "top_rate", "second_rate", "median_rate", "bottom_rate") == [(4, ord("a"), 1.0, 0.5, 0.375, 0.0)]


def test_loss_shares(make):
    deals = make([(0, 1), (0, 1), (1, 1), (1, 0)], "lost_reason_key int, is_lost int")
    reasons = make([(0, "Cancelled", "P"), (1, "Budget", "B")], "lost_reason_key int, lost_reason string, reason_category string")
    assert rows(loss.pareto(deals, reasons), "lost_reason", "pct_of_losses", "cum_pct") == [("Budget", 33.33, 100.0), ("Cancelled", 66.67, 66.67)]
    assert rows(loss.reason_share(deals, reasons, "Cancelled")) == [(2, 3, 66.67)]


def test_velocity_edges(make):
    meetings = make([(1, "Held", 0, 30), (2, "Held", 4, 31), (3, "Held", None, None), (4, "Cancelled", 2, 9)], "deal_key int, meeting_status string, days_from_create int, days_to_close int")
    deals = make([(1, 1), (2, 0), (3, 1), (4, 1)], "deal_key int, is_won int")
    assert rows(velocity.split(meetings, deals, 30)) == [(1, 1.0, 1, 0.0)]
    assert rows(velocity.summary(meetings), "metric", "median_days", "p90_days") == [("days_call_to_meeting", 2.0, 3.6), ("days_meeting_to_close", 30.0, 30.8)]


def test_survival_counts_month_twelve_churn_as_alive(make, dim):
    deals = make([deal(1, kept=0, churned=1), deal(2, kept=1, churned=1), deal(3, kept=11, churned=1), deal(4, kept=12, churned=1), deal(5, kept=12), deal(6, "d", won=0)], DEAL)
    got = {r["month"]: r["alive"] for r in retention.curve(deals, dim).collect()}
    assert got == {0: 5, 1: 4, **{m: 3 for m in range(2, 12)}, 12: 2}
    assert rows(retention.blended(deals), "won_n", "churned_n", "m12_retention_pct", "nrr_pct") == [(5, 4, 20.0, 20.0)]
    assert [r["read_note"] for r in retention.by_channel(deals, dim).collect()] == ["small n - directional"]


def test_channel_score_boundaries(make, dim):
    at_edge = [deal(i, "d", won=i < 10, mrr=15.0, hours=0.5, days=10, kept=12 if i < 8 else 3, churned=i in (8, 9)) for i in range(20)]
    got = scorecard.channel(make(at_edge, DEAL), dim)
    assert rows(got, "win_points", "dialer_points", "cycle_points", "retention_points", "score", "band") == [(50, 12, 8, 15, 85, "Scale")]
    poor = [deal(i, "d", won=i < 1, mrr=14.0, hours=1.0, days=26, churned=1) for i in range(10)]
    assert rows(scorecard.channel(make(poor, DEAL), dim), "win_points", "dialer_points", "cycle_points", "retention_points", "band") == [(12, -8, 0, 0, "Kill")]
    winless = [deal(i, "c", won=0) for i in range(3)]
    assert rows(scorecard.channel(make(winless, DEAL), dim), "win_points", "dialer_points", "cycle_points", "retention_points", "score", "band") == [(4, 30, 0, 0, 34, "Maintain")]


def test_lead_score_buckets(make):
    company = make([
        (1, "6-20", "Energy", "LLC"), (2, "6-20", "Transport", "Corporation"), (3, "51-200", "Retail", "Partnership"),
        (4, "1-5", "Consulting", "LLC"), (5, "21-50", "Energy", "LLC"), (6, "500+", "Energy", None), (7, "500+", "Energy", "LLC")],
        "company_key int, employee_band string, industry string, company_form string")
    cancels = make([(1, 1), (5, 2), (6, 1), (7, 2)], "company_key int, prior_cancels int")
    got = {r["company_key"]: (r["score"], r["band"]) for r in scorecard.lead(company, cancels).collect()}
    assert got == {1: (55, "Dial"), 2: (18, "Nurture"), 3: (16, "Nurture"), 4: (-32, "Skip"), 5: (2, "Skip"), 6: (5, "Nurture"), 7: (-10, "Skip")}
    edges = make([(50,), (49,), (5,), (4,)], "score int")
    from bizlens.functions.bands import band_when
    assert [r[0] for r in edges.select(band_when("score", scorecard.LEAD_CUTS, scorecard.LEAD_BANDS)).collect()] == ["Dial", "Nurture", "Nurture", "Skip"]


def test_coverage_boost_and_routing(spark, make, tmp_path):
    scored = make([(1, 60, "Dial", 0.9), (2, 40, "Nurture", 0.5), (3, 0, "Skip", None)], "company_key int, score int, band string, prob double")
    deals = make([(1, 1), (1, 1), (2, 1), (3, 0)], "company_key int, is_won int")
    assert rows(scorecard.coverage(scored, deals), "band", "universe_pct", "wins_pct") == [("Dial", 33.3, 66.7), ("Nurture", 33.3, 33.3), ("Skip", 33.3, 0.0)]
    boosted = scorecard.boost(scored, "prob", scorecard.Boost(20, 0.5))
    assert rows(boosted, "company_key", "boosted_score", "boosted_band") == [(1, 80, "Dial"), (2, 60, "Dial"), (3, 0, "Skip")]
    assert rows(scorecard.boost(scored, "prob", scorecard.Boost(20, None)), "company_key", "boosted_score") == [(1, 78), (2, 50), (3, 0)]
    scorecard.route(scored, str(tmp_path / "routes"))
    assert rows(spark.read.parquet(str(tmp_path / "routes")), "company_key", "action") == [(1, "call"), (2, "email"), (3, "none")]


LINE = "invoice_no int, invoice_date date, recognition_date date, customer_key string, product_key string, amount_expected double, amount_confirmed double, cost double, is_core boolean"


def line(no, age, amount=10.0, paid=0.0, cost=4.0, core=True, who="c", year=None):
    day = dt.date(2026, 1, 1) - dt.timedelta(days=age) if year is None else dt.date(year, 6, 1)
    return (no, day, day + dt.timedelta(days=40), who, "p", amount, paid, cost, core)


def test_ageing_edges(make):
    lines = make([line(i, a) for i, a in enumerate([-1, 0, 30, 31, 60, 61, 90, 91])] + [line(8, 5, paid=10.0), line(9, 5, paid=12.0)], LINE)
    got = finance.receivables(lines, dt.date(2026, 1, 1), not_due=True)
    assert rows(got) == [("c", 80.0, 20.0, 20.0, 20.0, 10.0, 10.0)]
    assert rows(finance.collection_list(finance.receivables(lines, dt.date(2026, 1, 1)), 1)) == [("c", 80.0, 10.0)]


def test_margin_uses_core_lines_only(make):
    lines = make([line(1, 1), line(2, 1, amount=100.0, cost=0.0, core=False)], LINE)
    margins = finance.margin_by_product(lines)
    assert rows(margins, "product_key", "contribution_margin_pct") == [("p", 60.0)]
    assert rows(finance.thin_margin(margins, 70.0, 80.0), "is_thin", "colour") == [(True, "red")]


def test_revenue_bases(make):
    lines = make([line(1, 0, year=2024, paid=10.0), line(2, 0, year=2025)], LINE).withColumn("recognition_date", F.lit(dt.date(2025, 1, 1)))
    assert rows(finance.revenue(lines, "Expected"), "year", "revenue") == [(2024, 10.0), (2025, 10.0)]
    assert rows(finance.revenue(lines, "Confirmed"), "year", "revenue") == [(2024, 10.0), (2025, 0.0)]
    assert rows(finance.revenue(lines, "Recognized"), "year", "revenue") == [(2025, 20.0)]


@pytest.mark.parametrize("ledger,explained,ok", [(1015.0, 10.0, True), (1015.1, 10.0, False), (985.1, -10.0, True), (984.0, -10.0, False)])
def test_reconcile_gate(make, ledger, explained, ok):
    lines = make([line(1, 0, amount=1000.0, year=2024), line(2, 0, amount=77.0, year=2023)], LINE)
    books = make([(2024, ledger), (2023, 9.0)], "year int, amount double")
    items = make([(2024, explained)], "year int, amount double")
    got = finance.reconcile(lines, books, items, 2024, 0.005).first()
    assert got["passed"] is ok and got["invoiced"] == 1000.0


def test_customer_ranks(make):
    lines = make([line(1, 1, 100.0, cost=90.0, who="a"), line(2, 1, 50.0, cost=5.0, who="b"), line(3, 1, 50.0, cost=45.0, who="d")], LINE)
    want = [("a", 1, 2, -1), ("b", 2, 1, 1), ("d", 2, 3, -1)]
    assert rows(finance.customer_profit(lines), "customer_key", "revenue_rank", "contribution_rank", "rank_delta") == want


PLAN = "product_key string, expected_sales double, stock_on_hand double, incoming double, production_need double"


def test_what_if_nets_or_floors(make):
    plan = make([("short", 100.0, 40.0, 0.0, 60.0), ("over", 50.0, 200.0, 10.0, 0.0)], PLAN)
    assert rows(planning.what_if(plan, [-0.2, 0.0, 0.5])) == [(-0.2, -130.0), (0.0, -100.0), (0.5, -25.0)]
    assert rows(planning.what_if(plan, [-0.2, 0.0, 0.5], floor=True, capacity=70)) == [(-0.2, 40.0, 0.0), (0.0, 60.0, 0.0), (0.5, 110.0, 40.0)]
    assert planning.uplift_grid()[0] == -0.2 and planning.uplift_grid()[-1] == 0.5 and len(planning.uplift_grid()) == 15


def test_lot_size_at_exact_multiples(make):
    plan = make([("a", 0.0, 0.0, 0.0, 200.0), ("b", 0.0, 0.0, 0.0, 10.0), ("c", 0.0, 0.0, 0.0, 0.0)], PLAN)
    assert rows(planning.lot_size(plan), "product_key", "plan_target", "lot_gap") == [("a", 250, 50.0), ("b", 150, 140.0)]
    assert rows(planning.lot_size(plan, exact_multiples=True), "plan_target") == [(150,), (200,)]


def test_safety_modes(make):
    params = make([("a", "A", True, 10.0, 20.0, 6.0), ("b", "B", None, 10.0, None, None)], "product_key string, variety_name string, active boolean, red_threshold double, safety_floor double, safety_months double")
    forecast = make([("a", "y", "x", 120.0), ("b", "y", "x", 12.0)], "product_key string, sales_year string, channel string, qty double")
    none = make([], "product_key string, as_of_date date, qty double")
    coming = make([], "product_key string, arrival_date date, qty double")
    assert rows(planning.production_plan(params, forecast, none, coming), "product_key", "production_need") == [("a", 140.0), ("b", 12.0)]
    assert rows(planning.production_plan(params, forecast, none, coming, safety_mode="documented"), "product_key", "production_need") == [("a", 180.0), ("b", 12.0)]
    assert planning.production_plan(params, forecast, none, coming, per_year=False).columns[2] == "expected_sales"


def test_roll_forward_equals_a_plain_loop(make):
    rnd = random.Random(11)
    years = [str(y) for y in range(2020, 2026)]
    products = {f"p{i}": (rnd.choice([0.0, 20.0]), float(rnd.randint(0, 80)), [(float(rnd.randint(0, 60)), float(rnd.randint(0, 40))) for _ in years]) for i in range(20)}
    params = make([(p, True, s) for p, (s, _, _) in products.items()], "product_key string, active boolean, safety_floor double")
    forecast = make([(p, y, "x", s) for p, (_, _, f) in products.items() for y, (s, _) in zip(years, f)], "product_key string, sales_year string, channel string, qty double")
    stock = make([(p, dt.date(2019, 12, 31), o) for p, (_, o, _) in products.items()], "product_key string, as_of_date date, qty double")
    coming = make([(p, dt.date(int(y), 3, 1), i) for p, (_, _, f) in products.items() for y, (_, i) in zip(years, f)], "product_key string, arrival_date date, qty double")
    got = {(r["product_key"], r["sales_year"]): (r["production_need"], r["ending_stock"]) for r in planning.roll_forward(params, forecast, stock, coming).collect()}
    for p, (safety, level, flow) in products.items():
        for y, (s, i) in zip(years, flow):
            need = max(0.0, safety - (level + i - s))
            level = level + i - s + need
            assert got[p, y] == (need, level)


def test_history_and_plan_vs_actual(make):
    snaps = make([("a", "y", dt.date(2024, 1, 1), 10.0, 1.0, 5.0, "red"), ("a", "y", dt.date(2024, 2, 1), 12.0, 1.0, 7.0, "red")],
                 "product_key string, sales_year string, snapshot_date date, expected_sales double, ending_stock double, production_need double, status string")
    assert rows(planning.history(snaps), "snapshot_date", "need_change") == [(dt.date(2024, 1, 1), None), (dt.date(2024, 2, 1), 2.0)]
    sold = make([("a", "y", 9.0)], "product_key string, sales_year string, qty double")
    assert rows(planning.plan_vs_actual(snaps, sold)) == [("a", "y", 12.0, 9.0, -3.0)]
    due = planning.start_by(snaps.limit(1), F.lit(dt.date(2025, 3, 31)), 1).first()
    assert due["start_by"] == dt.date(2025, 2, 28)


def test_spread_on_text_keys(make):
    from bizlens.plans.segments import spread

    got = spread(make([("R01", 1), ("R01", 0), ("R02", 1), ("R03", 0)], "rep_key string, is_won int"), "rep_key").first()
    assert (got["members"], got["top_key"], got["top_rate"], got["second_rate"], got["bottom_rate"]) == (3, "R02", 1.0, 0.5, 0.0)
