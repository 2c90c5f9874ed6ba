import itertools
import re
import time

import pytest

from bizlens.llm import filter_audit
from tests.llm.conftest import ODD


def bits(text):
    t = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    upper = sum(1 for c in t if "A" <= c <= "Z")
    return ((len(words) < 100) * 1 + (100 * len(set(words)) < 80 * len(words)) * 2
            + (100 * upper > 10 * len(t)) * 4 + bool(re.search(r"[#$%&*|]", t)) * 8)


def brute(rows, labels):
    """Every order applied filter by filter to Python rows."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    docs = [(lang or "", bits(t) | (16 if i is not None and i > least[t or ""] else 0), i in good, i in toxic) for i, t, lang in rows]
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        shap = {f: 0 for f in range(5)}
        for order in itertools.permutations(range(5)):
            for f in range(5):
                earlier = sum(1 << k for k in order[:order.index(f)])
                shap[f] += sum(1 for d in mine if d[1] >> f & 1 and not d[1] & earlier)
        for order in itertools.permutations(range(5)):
            name = "".join("ABCDE"[k] for k in order)
            for s, f in enumerate(order):
                earlier, bit = sum(1 << k for k in order[:s]), 1 << f
                removed = [d for d in mine if d[1] & bit and not d[1] & earlier]
                out[(part, name, s + 1)] = (
                    sum(1 for d in mine if not d[1] & (earlier | bit)), len(removed),
                    sum(1 for d in mine if d[1] & bit and d[1] & earlier), sum(1 for d in mine if d[1] == bit),
                    sum(1 for d in removed if d[2]), sum(1 for d in removed if d[3]), shap[f])
    return out


def words(k, n, distinct=True):
    return " ".join(f"w{(j if distinct else j % 7)}x{k}" for j in range(n))


ROWS = [(i, t, "en" if (i or 0) % 3 else None) for i, t in ODD] + [
    (30, words(1, 150), "en"), (31, words(1, 150), "en"), (32, words(2, 150, False), "de"), (33, words(3, 120).upper(), "de"),
    (34, words(4, 130) + " #", "fr"), (35, words(4, 130) + " #", "fr"), (36, words(5, 100), "fr"), (37, words(6, 99), "fr"),
]
LATER = [(29, words(1, 150), "de"), (3, "a", None), (None, words(5, 100), "fr"), (36, words(5, 100), "fr")]
LABELS = [(30, 1, 0), (31, 0, 1), (31, 1, 1), (34, 1, 0), (35, 0, 1), (29, 1, 1), (999, 1, 1)]


def written(spark, tmp_path, batches):
    path = str(tmp_path / "docs")
    for rows in batches:
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    return path


def test_equals_brute_force_with_retractions(spark, tmp_path):
    rows = [(i, t, lang, "s") for i, t, lang in ROWS]
    later = [(i, t, lang, "s") for i, t, lang in LATER]
    path = written(spark, tmp_path, [rows[:12], rows[12:], later])
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(spark, path, labels, files_per_batch=1).collect()
    want = brute(ROWS + LATER, LABELS)
    assert len(got) == len(want) == 600 * len({(lang or "") for _, _, lang in ROWS + LATER})
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got} == want
    changes = filter_audit.changes(spark, path, labels, files_per_batch=1)
    assert changes.filter("delta < 0").count() > 0  # the later, smaller ids retracted earlier counts


def test_long_texts_and_empty_table(spark, tmp_path):
    long = [(1, "word " * 400_000 + "|", "en"), (2, "Ab " * 300_000, "en")]
    path = written(spark, tmp_path, [[(i, t, lang, "s") for i, t, lang in long]])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {(r.filter_order, r.step): (r.kept, r.removed) for r in filter_audit.audit(spark, path, labels).collect()}
    assert got[("ABCDE", 2)] == (0, 2) and got[("DCBAE", 1)] == (1, 1) and got[("CABDE", 1)] == (1, 1)
    empty = written(spark, tmp_path / "e", [[]])
    assert filter_audit.audit(spark, empty, labels).count() == 0


def test_one_state_read_and_write_per_text_of_a_call():
    """Batches of one call share the state of a text, and an unchanged state is not written."""
    import pandas as pd

    class State:
        def __init__(self):
            self.kept, self.calls = {}, []

        def getMapState(self, *_):
            return self

        def getValue(self, key):
            self.calls.append("get")
            return self.kept.get(key)

        def updateValue(self, key, value):
            self.calls.append("put")
            self.kept[key] = value

    def batch(*rows):
        return pd.DataFrame(rows, columns=filter_audit.ROWS.replace(",", "").split()[::2])

    def summed(out):
        return {tuple(r[:4]): r[4] for frame in out for r in frame.itertuples(index=False)}

    state, audit = State(), filter_audit.Retraction()
    audit.init(state)
    first = [batch(("t", "en", 1, 0, 0, 2, 7, 1, 0), ("t", "de", 1, 1, 0, 1, 9, 1, 0)), batch(("t", "en", 1, 0, 0, 1, 5, 1, 3))]
    assert summed(audit.handleInputRows((0,), iter(first), None)) == {("en", 1, 0, 0): 4, ("en", 17, 0, 0): 2, ("de", 17, 1, 0): 1}
    assert state.calls == ["get", "put"]
    assert summed(audit.handleInputRows((0,), iter([batch(("t", "de", 1, 1, 0, 1, 6, 1, 0))]), None)) == {("de", 17, 1, 0): 1}
    assert state.calls == ["get", "put", "get"]
    assert summed(audit.handleInputRows((0,), iter([batch(("t", "de", 1, 1, 0, 1, 2, 1, 0))]), None)) == {("en", 1, 0, 0): -1, ("en", 17, 0, 0): 1, ("de", 1, 1, 0): 1}
