import random

import pytest

from bizlens.plans import ml
from tests.conftest import rows


@pytest.fixture(scope="module")
def data():
    rnd = random.Random(2)
    return [(i, rnd.randint(0, 20) / 20, rnd.randint(0, 1), rnd.choice("xy")) for i in range(300)]


@pytest.fixture(scope="module")
def scored(make, data):
    return make(data, "id int, score double, label int, slice string").cache()


def brute_auc(rs):
    pos, neg = [s for _, s, y, _ in rs if y], [s for _, s, y, _ in rs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_against_all_pairs(scored, data):
    assert ml.auc(scored).first()["auc"] == pytest.approx(brute_auc(data), abs=1e-7)
    by = {r["slice"]: r["auc"] for r in ml.auc_by(scored, "slice").collect()}
    assert by == {k: pytest.approx(brute_auc([r for r in data if r[3] == k]), abs=1e-7) for k in "xy"}


def test_auc_without_negatives_is_null(make):
    assert ml.auc(make([(0.5, 1)], "score double, label int")).first()["auc"] is None


def test_roc_ends_at_one(scored, data):
    points = {r["threshold"]: (r["fpr"], r["tpr"]) for r in ml.roc(scored).collect()}
    assert points[0.0] == (1.0, 1.0)
    pos, neg = sum(y for *_, y, _ in data), sum(1 - y for *_, y, _ in data)
    assert points[0.5] == (pytest.approx(sum(1 for _, s, y, _ in data if s >= 0.5 and not y) / neg, abs=1e-7),
                           pytest.approx(sum(1 for _, s, y, _ in data if s >= 0.5 and y) / pos, abs=1e-7))


def test_threshold_is_inclusive_by_choice(make):
    df = make([(0.5, 1), (0.4, 0)], "score double, label int")
    assert rows(ml.confusion(df)) == [(0, 0, 1), (1, 1, 1)]
    assert rows(ml.confusion(df, inclusive=False)) == [(0, 0, 1), (1, 0, 1)]
    assert rows(ml.precision_at(df, 0.4), "precision") == [(0.5,)]


def test_calibration_and_histogram_edges(make):
    df = make([(0.0, 0), (0.1, 1), (1.0, 1)], "score double, label int")
    assert rows(ml.calibration(df), "bin", "n", "positive_rate") == [(0, 1, 0.0), (1, 1, 1.0), (9, 1, 1.0)]
    assert rows(ml.score_hist(df, 2), "label", "bin", "n") == [(0, 0, 1), (1, 0, 1), (1, 1, 1)]


def test_top_decile_includes_ties(make):
    df = make([(i, float(s)) for i, s in enumerate([9, 8, 8] + [1] * 17)], "id int, score double")
    got = ml.top_decile_lift(df).first()
    assert got["n_top"] == 3 and got["top_mean"] == pytest.approx(25 / 3) and got["lift"] == pytest.approx((25 / 3) / (42 / 20), abs=1e-6)


def test_lift_curve_ends_at_one(scored):
    curve = {r["step"]: r["lift"] for r in ml.lift_curve(scored).collect()}
    assert set(curve) == set(range(1, 11)) and curve[10] == 1.0


def test_split_is_exact_and_repeatable(make):
    df = make([(i, int(i % 3 == 0)) for i in range(1000)], "id int, label int")
    once, again = ml.stratified_split(df, "label", "id"), ml.stratified_split(df.repartition(7), "label", "id")
    assert rows(once.filter("is_test").groupBy("label").count()) == [(0, round(666 * 0.2)), (1, round(334 * 0.2))]
    assert rows(once.filter("is_test"), "id") == rows(again.filter("is_test"), "id")


def test_drift_alert(make):
    history = make([("m", 1, 0.76), ("m", 2, 0.75), ("m", 3, 0.70)], "model string, week int, auc double")
    assert rows(ml.drift(history), "week", "alert") == [(1, False), (2, False), (3, True)]


def test_trees_learn_a_rule_and_name_their_features(make):
    rnd = random.Random(4)
    data = [(f"{i:08d}", "n", rnd.choice(["ApS", "A_S"]), 1990 + i % 30, bool(i % 2), False) for i in range(400)]
    data = [(*r[:5], r[2] == "A_S" and r[3] > 2000) for r in data]
    df = make(data, "cvr string, company_name string, company_form string, founded_year int, has_subsidiaries boolean, uses_target_software boolean")
    feats = ml.featurise(df)
    assert feats.filter("cvr = '00000000'").first()["company_age"] == 35 and "company_name" not in feats.columns
    model = ml.train(feats, ["company_form"], ["founded_year", "has_subsidiaries", "company_age"], trees=5, depth=3)
    scored = ml.score(model, feats)
    assert ml.auc(scored, "prob").first()["auc"] > 0.95
    top = ml.top_features(model, feats, 2).collect()
    assert len(top) == 2 and top[0]["importance"] >= top[1]["importance"] > 0
    joined = ml.attach_scores(df, scored.filter("cvr <> '00000001'"))
    assert joined.count() == 400 and rows(joined.filter("prob is null"), "cvr") == [("00000001",)]


def test_split_keeps_rows_without_label_or_id(make):
    df = make([(k if k % 10 else None, [0, 1, None][k % 3]) for k in range(300)], "id int, label int")
    out = ml.stratified_split(df, "label", "id").groupBy("label", "is_test").count().collect()
    assert {(r["label"], r["is_test"]): r["count"] for r in out} == {(x, t): 20 if t else 80 for x in (0, 1, None) for t in (True, False)}
