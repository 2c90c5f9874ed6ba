import pytest


from bizlens.plans import measures, report
from bizlens.plans.measures import Star, evaluate
from tests.conftest import rows

REGISTRY = measures.standard_measures("Cancelled", ["Transport"], "6-20", "Rebook")


@pytest.fixture(scope="module")
def star(make):
    deals = make([
        (1, 1, "c1", 0, 1, 0, 100.0, 4.0, 5, 1, 100.0), (2, 1, "c1", 0, 0, 1, 0.0, 1.0, None, 0, 0.0),
        (3, 2, "c2", 1, 1, 0, 50.0, 0.0, 9, 0, 0.0), (4, 2, "c2", 1, 0, 1, 0.0, 0.0, None, 0, 0.0)],
        "deal_key int, company_key int, channel_key string, lost_reason_key int, is_won int, is_lost int, mrr_usd double, dialer_hours double, deal_age_days int, is_churned int, churned_mrr double")
    calls = make([(1, 1, 1), (1, 0, 0), (3, 1, 0)], "company_key int, is_connected int, is_meeting_booked int")
    meetings = make([(1, 1, "c1", "Held", 1, 2, 1), (2, 1, "c1", "Held", 3, None, 0), (3, 2, "c2", "Held", 0, 4, 1), (3, 2, "c2", "Cancelled", 0, 4, 1)],
                    "deal_key int, company_key int, channel_key string, meeting_status string, days_from_create int, days_to_close int, is_won int")
    dims = {
        "company": make([(1, "6-20", "Transport"), (2, "1-5", "Retail"), (3, "1-5", "Energy")], "company_key int, employee_band string, industry string"),
        "channel": make([("c1", "Rebook", "Out"), ("c2", "SEO", "In")], "channel_key string, channel_name string, channel_group string"),
        "lost_reason": make([(0, "Cancelled", "P"), (1, "Budget", "B")], "lost_reason_key int, lost_reason string, reason_category string"),
    }
    paths = {(f, "company"): "company_key" for f in ("deals", "calls", "meetings")} | {(f, "channel"): "channel_key" for f in ("deals", "meetings")} | {("deals", "lost_reason"): "lost_reason_key"}
    return Star({"deals": lambda: deals, "calls": lambda: calls, "meetings": lambda: meetings}, dims, paths)


def test_cross_fact_ratio_keeps_facts_apart(star):
    got = evaluate(star, REGISTRY, ["total_calls", "meetings_held", "win_rate_meeting", "win_rate_call"], ["industry"])
    assert rows(got) == [("Energy", 1.0, 0.0, None, None), ("Retail", 0.0, 1.0, 1.0, None), ("Transport", 2.0, 2.0, 0.5, 0.5)]


def test_shares_remove_the_channel_filter(star):
    got = evaluate(star, REGISTRY, ["volume_share", "won_mrr_share"], ["channel_name"])
    assert rows(got) == [("Rebook", 0.5, pytest.approx(2 / 3)), ("SEO", 0.5, pytest.approx(1 / 3))]


def test_flags_filters_and_retention(star):
    assert rows(evaluate(star, REGISTRY, ["anti_icp_flag", "retention_rate", "mrr_per_dialer_hour"], ["industry"])) == [("Retail", 0.0, 1.0, None), ("Transport", 1.0, 0.0, 20.0)]
    assert rows(evaluate(star, REGISTRY, ["anti_icp_flag", "deals"])) == [(0.0, 4.0)]
    only = evaluate(star, REGISTRY, ["deals", "cancellation_share_of_losses"], where={"channel_group": lambda c: c == "Out"})
    assert rows(only) == [(2.0, 1.0)]


def test_sweet_spot_and_cycle(star):
    got = evaluate(star, REGISTRY, ["sweet_spot_lift", "avg_days_meeting_to_won", "meeting_cancel_rate"])
    assert rows(got) == [(pytest.approx(0.5 - 2 / 3), pytest.approx(10 / 3), 0.25)]


def test_totals_ignore_the_filters_they_remove(star):
    got = evaluate(star, REGISTRY, ["volume_share", "won_mrr_share", "deals"], where={"channel_name": lambda c: c == "SEO"})
    assert rows(got) == [(0.5, pytest.approx(1 / 3), 2.0)]
    cut = evaluate(star, REGISTRY, ["volume_share"], ["channel_name", "industry"], where={"channel_group": lambda c: c == "Out"})
    assert rows(cut) == [("Rebook", "Transport", 1.0)]


def test_fixed_conditions_stand_in_place_of_the_context(star):
    got = {r["employee_band"]: r["sweet_spot_lift"] for r in evaluate(star, REGISTRY, ["sweet_spot_lift"], ["employee_band"]).collect()}
    assert got == {"6-20": 0.0, "1-5": -0.5}
    share = evaluate(star, REGISTRY, ["cancellation_share_of_losses"], ["lost_reason"])
    assert rows(share) == [("Budget", 1.0), ("Cancelled", 1.0)]


def test_parameters_of_domain_measures(star):
    assert "top_decile_lift" not in measures.domain_measures() and "top_decile_lift" in measures.domain_measures(top=0.9)


def test_unreachable_attribute_is_refused(star):
    with pytest.raises(ValueError):
        evaluate(star, REGISTRY, ["total_calls"], ["channel_name"])


def test_guard_and_report(star):
    assert measures.guard(REGISTRY, ["deals", "nope"]) == ["nope"]
    assert not [m for page in report.PAGES.values() for m, _ in page.values() if m not in REGISTRY]
    got = report.dataset(star, REGISTRY, "channel_segments")
    assert ("by_channel", "Rebook", None, 0.5) in rows(got) and ("channel_by_band", "SEO", "1-5", 0.5) in rows(got)
    assert set(report.datasets(star, REGISTRY, "overview")) == set(report.PAGES["overview"])
