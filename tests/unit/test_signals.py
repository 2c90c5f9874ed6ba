import datetime as dt

import pytest
from pyspark.sql import functions as F

from bizlens.plans import signals
from tests.conftest import rows

MENTION = "mention_id int, entity string, source string, bucket string, tier string, region string, ts timestamp, day date"


def seen(make, data):
    out = []
    for i, (entity, source, bucket, day, *rest) in enumerate(data):
        tier, region = (rest + ["mainstream", "US"])[:2] if len(rest) < 2 else rest
        d = dt.date(2024, 1, 1) + dt.timedelta(days=day)
        out.append((i, entity, source, bucket, tier, region, dt.datetime.combine(d, dt.time(12)), d))
    return make(out, MENTION)


def test_points_reach_and_ablation(make):
    df = make([(1, 0), (1, 1), (0, 0), (1, 0)], "has_jobposting int, has_paid_ads int")
    scored = signals.intent_score(df, {"has_jobposting": 10, "has_paid_ads": 8})
    assert rows(signals.contribution(scored)) == [("has_jobposting", 3, 10, 30), ("has_paid_ads", 1, 8, 8)]
    assert rows(signals.ablation(scored)) == [("has_jobposting", 7.5), ("has_paid_ads", 2.0)]
    assert rows(signals.lift(scored, ["has_paid_ads"])) == [("has_paid_ads", 18.0, pytest.approx(20 / 3, abs=1e-6), pytest.approx(18 - 20 / 3, abs=1e-6))]
    assert rows(signals.coverage(df, ["has_jobposting", "has_paid_ads"], ["has_paid_ads"]), "at_least_1", "at_least_2", "covered") == [(3, 1, 1)]


def test_convergence_needs_three_sources_in_seven_days(make):
    m = seen(make, [
        ("two", "a", "x", 0), ("two", "b", "y", 1),
        ("one_bucket", "a", "x", 0), ("one_bucket", "b", "x", 1), ("one_bucket", "c", "x", 6),
        ("edge", "a", "x", 0), ("edge", "b", "y", 3), ("edge", "c", "x", 7),
        ("wide", "a", "x", 0), ("wide", "b", "y", 3), ("wide", "c", "x", 6), ("wide", "c", "x", 6)])
    got = signals.convergence(m)
    assert rows(got, "entity", "rule") == [("one_bucket", "weak_signal"), ("wide", "convergence")]


def test_anomaly_waits_for_history(make):
    quiet = [("e", "a", "x", d) for d in range(0, 50, 2)]
    burst = [("e", "a", "x", 45)] * 30
    early = [("f", "a", "x", 40)] * 3 + [("f", "a", "x", 45)] * 30
    got = signals.anomaly(seen(make, quiet + burst + early), 30)
    found = {(r["entity"], r["day"]) for r in got.collect()}
    assert ("e", dt.date(2024, 2, 15)) in found and not any(e == "f" for e, _ in found)


def test_first_mover_and_route(make):
    m = seen(make, [
        ("early", "n", "x", 0, "niche", "CN"), ("early", "m", "x", 14, "mainstream", "EU"), ("early", "m", "x", 20, "mainstream", "US"),
        ("close", "n", "x", 0, "niche", "CN"), ("close", "m", "x", 13, "mainstream", "US"), ("close", "m", "x", 15, "mainstream", "EU"),
        ("niche_only", "n", "x", 0, "niche", "CN")])
    assert rows(signals.first_mover(m), "entity", "lead_days") == [("early", 14)]
    assert rows(signals.geo_spread(m), "entity") == [("early",)]


def test_rules_without_data_are_logged(make):
    m = seen(make, [("e", "a", "x", 0, "niche", "CN"), ("e", "b", "y", 3, "niche", "CN"), ("e", "c", "y", 4, "niche", "CN")])
    found, log = signals.run(m)
    assert rows(found, "rule", "entity") == [("convergence", "e")]
    assert rows(log, "rule") == [("anomaly",), ("first_mover",), ("geo_spread",)]


def test_trend_break(make):
    prices = make([("p", dt.date(2024, 1, 1) + dt.timedelta(days=i), 10.0 + i % 2) for i in range(20)] + [("p", dt.date(2024, 1, 21), 30.0)], "k string, d date, price double")
    assert rows(signals.trend_break(prices, ["k"], "d", "price"), "d") == [(dt.date(2024, 1, 21),)]


def test_rank_state_and_evidence(make):
    s = make([("s1", "e1", 2), ("s2", "e2", 1), ("s3", "e1", 2)], "signal_id string, entity string, strength int")
    watch = make([("c1", "e1", 1), ("c1", "e2", 9), ("c2", "e1", 1)], "customer string, entity string, weight int")
    top = signals.rank(s, watch, 2)
    assert rows(top, "customer", "signal_id", "position") == [("c1", "s1", 2), ("c1", "s2", 1), ("c2", "s1", 1), ("c2", "s3", 2)]
    state = make([("c1", "s2", "rejected")], "customer string, signal_id string, state string")
    assert rows(signals.with_state(top, state), "customer", "signal_id", "state")[1] == ("c1", "s2", "rejected")
    quotes = make([("s1", i, dt.datetime(2024, 1, 1 + i), f"q{i}") for i in range(3)], "signal_id string, evidence_id int, ts timestamp, quote string")
    names = make([("s1", "e1"), ("s1", "e9"), ("s2", "e2")], "signal_id string, entity string")
    got = signals.with_evidence(s.select("signal_id"), quotes, names)
    assert rows(got, "signal_id", "n_evidence", "n_entities", "first_quote") == [("s1", 3, 2, "q0"), ("s2", 0, 1, None), ("s3", 0, 0, None)]
    assert signals.evidence_rows(s, quotes, names).count() == 6


def test_timeline_digest_and_health(make):
    m = seen(make, [("e", "a", "x", 0), ("e", "b", "x", 0), ("z", "a", "x", 1)])
    line = signals.entity_timeline(m, ["e"], dt.date(2024, 1, 3), 3)
    assert rows(line, "day", "n", "n_sources") == [(dt.date(2024, 1, d), n, n) for d, n in ((1, 2), (2, 0), (3, 0))]
    assert signals.digest(m, dt.date(2023, 12, 26)).count() == 2
    runs = make([("a", 1, dt.datetime(2024, 1, 1), "ok"), ("a", 2, dt.datetime(2024, 1, 2), "failed"), ("b", 3, dt.datetime(2024, 1, 2), "ok"), ("c", 4, dt.datetime(2024, 1, 2), "failed")],
                "source string, run_id int, ts timestamp, status string")
    health = signals.source_health(runs, F.lit(dt.datetime(2024, 1, 2, 1)), 24)
    assert rows(health, "source", "last_status", "failures", "silent") == [("a", "failed", 1, True), ("b", "ok", 0, False), ("c", "failed", 1, True)]
    assert rows(signals.run_history(runs, 1), "source", "run_id") == [("a", 2), ("b", 3), ("c", 4)]
