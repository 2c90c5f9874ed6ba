import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from bizlens.operators import aggregate, joins, ordering, quality
from tests.conftest import rows


def test_drill_across_does_not_fan_out(make):
    rep = make([("r1",), ("r2",)], "rep_key string")
    calls = make([("r1", 1), ("r1", 1)], "rep_key string, c int")
    deals = make([("r1", 1), ("r1", 0), ("r1", 1)], "rep_key string, w int")
    got = aggregate.drill_across(rep, {"c": (calls, [F.sum("c").alias("calls")]), "d": (deals, [F.sum("w").alias("won")])}, "rep_key")
    assert rows(got) == [("r1", 2, 2), ("r2", None, None)]


def test_segment_rates_with_group_cut(make):
    df = make([("a", 1)] * 3 + [("b", 0)], "k string, w int")
    assert rows(aggregate.segment_rates(df, ["k"], "w", min_n=2)) == [("a", 3, 3, 100.0)]


def test_totals_recompute_ratios(make):
    df = make([("x", "a", 1), ("x", "b", 0), ("y", "a", 1)], "g string, k string, w int")
    got = aggregate.with_totals(df, ["g", "k"], [F.avg("w").alias("r")])
    assert [r for r in rows(got) if r[2] == 3] == [(None, None, 3, pytest.approx(2 / 3))]


def test_histogram_keeps_the_top_edge(make):
    got = aggregate.histogram(make([(0.0,), (0.5,), (1.0,), (1.2,)], "v double"), "v", 0, 1, 2)
    assert rows(got) == [(0, 1, 0.0), (1, 2, 0.5)]


def test_one_row_and_steps(make):
    a, b = make([(1,), (2,)], "x int"), make([(5,)], "y int")
    assert rows(aggregate.one_row([(a, {"s": F.sum("x")}), (b, {"t": F.sum("y")})])) == [(3, 5)]
    assert rows(aggregate.stack_steps([("first", a, F.count(F.lit(1))), ("second", b.filter("y > 9"), F.sum("y"))])) == [(1, "first", 2), (2, "second", 0)]


def test_running_total_over_hot_values(make):
    rnd = random.Random(7)
    data = [(i, rnd.randint(-50, 50), rnd.randint(1, 9), rnd.choice("ab")) for i in range(400)]
    df = make(data, "id int, v int, n int, g string")
    got = {r["id"]: r["run"] for r in ordering.running_total(df, [("v", True), ("id", False)], {"run": "n"}).collect()}
    total, want = 0, {}
    for i, v, n, _ in sorted(data, key=lambda r: (-r[1], r[0])):
        total += n
        want[i] = total
    assert got == want
    by = {r["id"]: r["run"] for r in ordering.running_total(df, [("v", False), ("id", False)], {"run": "n"}, by=["g"]).collect()}
    sums, want = {"a": 0, "b": 0}, {}
    for i, v, n, g in sorted(data, key=lambda r: (r[1], r[0])):
        sums[g] += n
        want[i] = sums[g]
    assert by == want


def test_ranks_with_a_heavy_tie(make):
    data = [(i, 5.0 if i < 40 else float(i)) for i in range(60)]
    got = {r["id"]: r["rk"] for r in ordering.rank_by(make(data, "id int, v double"), {"rk": "v"}).collect()}
    assert got == {i: 1 + sum(1 for _, o in data if o > v) for i, v in data}


def test_pareto_and_concentration(make):
    df = make([("a", 50), ("b", 30), ("c", 15), ("d", 5)], "k string, v int")
    assert rows(ordering.pareto(df, "k", "v"), "k", "cum_share_pct") == [("a", 50.0), ("b", 80.0), ("c", 95.0), ("d", 100.0)]
    assert rows(ordering.concentration(df, "k", "v", 2)) == [(100.0, 100.0), (50.0, 80.0)]


def test_top_fraction_keeps_ties(make):
    df = make([(i, float(s)) for i, s in enumerate([9, 8, 8, 8, 1, 1, 1, 1, 1, 1])], "id int, s double")
    assert rows(ordering.top_fraction(df, "s", 0.2), "id") == [(0,), (1,), (2,), (3,)]


def test_latest_and_last_n(make):
    df = make([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z"), ("a", 2, "w")], "k string, t int, v string")
    assert rows(ordering.latest_per_key(df, ["k"], ["t"])) == [("a", 3, "y"), ("b", 2, "z")]
    assert rows(ordering.last_n(df, ["k"], [F.col("t").desc()], 2), "k", "t", "recency") == [("a", 2, 2), ("a", 3, 1), ("b", 2, 1)]


def test_prior_events_against_brute_force(make):
    rnd = random.Random(3)
    data = [(i, "hot" if rnd.random() < 0.6 else f"k{rnd.randint(0, 3)}", dt.date(2024, 1, rnd.randint(1, 5)), rnd.randint(0, 1)) for i in range(120)]
    got = {r["id"]: r["prior"] for r in ordering.prior_events(make(data, "id int, k string, d date, f int"), "k", "d", ["id"], F.col("f") == 1, "prior").collect()}
    assert got == {i: sum(g for j, l, e, g in data if l == k and (e, j) < (d, i)) for i, k, d, _ in data}


def test_baseline_counts_missing_days_as_zero(make):
    import statistics

    days = {1: 4, 2: 6, 5: 8, 9: 20}
    df = make([("e", dt.date(2024, 1, d), n) for d, n in days.items()], "k string, d date, n int")
    got = {r["d"].day: r for r in ordering.baseline_z(df, ["k"], "d", "n", days=7).collect()}
    window = [days.get(x, 0) for x in range(2, 9)]
    assert got[9]["base_mean"] == pytest.approx(statistics.mean(window))
    assert got[9]["base_std"] == pytest.approx(statistics.stdev(window))
    assert got[9]["z"] == pytest.approx((20 - statistics.mean(window)) / statistics.stdev(window))
    assert got[9]["history_days"] == 8 and got[1]["z"] is None


def test_diverse_feed_and_paging(make):
    df = make([(i, "big" if i % 4 else f"s{i}") for i in range(40)], "ts int, source string")
    page = ordering.diversify(df, "source", [F.col("ts").desc()], size=20, cap=3).collect()
    assert sum(r["source"] == "big" for r in page) == 3 and len(page) == 13
    assert [r["ts"] for r in ordering.feed(df, F.col("source") == "big", [F.col("ts").desc()], page=1, size=5).collect()] == [33, 31, 30, 29, 27]


def test_shares(make):
    df = make([("a", "x", 1), ("a", "y", 3), ("b", "z", 4)], "g string, k string, n int")
    assert rows(ordering.share(df, "n", "p"), "k", "p") == [("x", 12.5), ("y", 37.5), ("z", 50.0)]
    assert rows(ordering.share(df, "n", "p", by=["g"]), "k", "p") == [("x", 25.0), ("y", 75.0), ("z", 100.0)]


def test_join_shapes(make):
    fact = make([(1, 20240101, 0), (2, 20240102, 20240101)], "id int, created int, won int")
    cal = make([(20240101, "mon"), (20240102, "tue")], "date_key int, day string")
    assert rows(joins.join_date(fact, cal, "won"), "id", "day") == [(2, "mon")]
    plan = make([("a", 10.0), ("b", 5.0)], "k string, total double")
    detail = make([("a", 4.0), ("a", 6.0), ("b", 4.9)], "k string, q double")
    assert rows(joins.reconcile_sums(plan, detail, ["k"], "total", "q", 0.05), "k") == [("b",)]
    assert joins.scenario_grid(plan, [0.0, 0.5], "u").count() == 4
    kids = make([(1, "Held"), (1, "Held"), (2, "Cancelled")], "id int, s string")
    assert rows(joins.cohort(fact, kids, "id", F.col("s") == "Held"), "id") == [(1,)]


def test_integrity_gates(make):
    df = make([(1, "a"), (1, "a"), (2, None)], "id int, k string")
    dim = make([("b",)], "k string")
    assert rows(quality.pk_violations(df, ["id"])) == [(1, 2)]
    assert rows(quality.null_violations(df, ["id", "k"])) == [("id", 0), ("k", 1)]
    assert rows(quality.fk_orphans(df, dim, "k")) == [("a", 2)]
    assert rows(quality.citation_check(df, dim, "k"), "id") == [(1,), (1,)]
    from pyspark.sql.types import StructType
    assert rows(quality.check_schema(df, StructType.fromDDL("id bigint, z string")), "column_name", "problem") == [("id", "type"), ("k", "extra"), ("z", "missing")]


def test_anchor_and_numbers_gates(make):
    got = make([("a", 1.004, "red"), ("b", 2.0, "green")], "k string, v double, s string")
    anchors = make([("a", 1.0, "red"), ("b", 2.5, "red"), ("c", 1.0, "red")], "k string, v double, s string")
    assert rows(quality.assert_anchors(got, anchors, "k"), "k", "field") == [("b", "s"), ("b", "v"), ("c", "s"), ("c", "v")]
    metrics = quality.metric_rows({"n": (got, F.count(F.lit(1))), "s": (got, F.sum("v"))})
    expected = make([("n", 2.0), ("s", 9.0), ("gone", 1.0)], "metric string, value double")
    assert rows(quality.verify(metrics, expected), "metric") == [("gone",), ("s",)]


def test_running_total_with_nulls_and_equal_values(make):
    data = [(i, None if i % 5 == 0 else 7.0, i % 3 if i % 3 else None) for i in range(400)]
    df = make(data, "id int, v double, g int").withColumn("n", F.lit(1))
    got = {r["id"]: r["run"] for r in ordering.running_total(df, [("v", True), ("id", False)], {"run": "n"}).collect()}
    want = sorted(data, key=lambda r: (r[1] is None, r[0]))
    assert [got[r[0]] for r in want] == list(range(1, 401))
    by = {r["id"]: r["run"] for r in ordering.running_total(df, [("v", True), ("id", False)], {"run": "n"}, by=["g"]).collect()}
    for g in (None, 1, 2):
        assert [by[r[0]] for r in want if r[2] == g] == list(range(1, sum(r[2] == g for r in data) + 1))


def test_ranks_keep_null_rows(make):
    got = ordering.rank_by(make([(1, 5.0), (2, None), (3, 9.0), (4, None)], "id int, v double"), {"rk": "v"}).collect()
    assert {r["id"]: r["rk"] for r in got} == {3: 1, 1: 2, 2: 3, 4: 3}


def test_pareto_total_with_negative_values(make):
    got = ordering.pareto(make([("a", 10), ("b", 5), ("c", -5)], "k string, v int"), "k", "v").collect()
    assert {r["k"]: (r["share_pct"], r["cum_share_pct"]) for r in got} == {"a": (100.0, 100.0), "b": (50.0, 150.0), "c": (-50.0, 100.0)}


def test_prior_events_keep_rows_without_key_or_day(make):
    data = [(1, "a", 1, True), (2, "a", 2, False), (3, None, 1, True), (4, None, 2, False), (5, "a", None, False)]
    df = make(data, "id int, k string, day int, hit boolean")
    got = ordering.prior_events(df, "k", "day", ["id"], F.col("hit"), "prior").collect()
    assert {r["id"]: r["prior"] for r in got} == {1: 0, 2: 1, 3: 0, 4: 1, 5: 1}


def test_latest_row_is_the_same_on_every_run(make):
    data = [(1, 3, "x"), (1, 3, "y"), (2, 1, "z"), (None, 5, "n")]
    first = ordering.latest_per_key(make(data, "k int, o int, v string"), ["k"], ["o"]).collect()
    again = ordering.latest_per_key(make(data[::-1], "k int, o int, v string"), ["k"], ["o"]).collect()
    assert sorted(first, key=repr) == sorted(again, key=repr) and len(first) == 3
