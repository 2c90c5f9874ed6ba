import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bizlens.operators.linking import drop_one_char, link_by_signature
from bizlens.functions.textual import is_junk_title
from bizlens.plans import text
from tests.conftest import rows


def groups(pairs, nodes):
    """Smallest node per connected group, by plain union-find."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n
    for a, b in pairs:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in nodes}


def same_story(a, b):
    a, b = set(a.split()), set(b.split())
    if a == b:
        return True
    if len(a) == len(b):
        return len(a) > 2 and len(a - b) == 1
    return max(len(a), len(b)) > 2 and abs(len(a) - len(b)) == 1 and (a < b or b < a)


def test_title_clusters_against_all_pairs(make):
    rnd = random.Random(5)
    words = "seed price rain crop farm trade law ship".split()
    titles = [(i, " ".join(rnd.sample(words, rnd.randint(2, 5)))) for i in range(70)]
    titles += [(i, "seed price rain") for i in range(70, 120)]          # a third are copies of one story
    titles.append((120, " !! "))
    pairs = [(i, j) for i, a in titles for j, b in titles if i < j and a.strip(" !") and b.strip(" !") and same_story(a, b)]
    chains = groups(pairs, [i for i, _ in titles])
    sets = {i: frozenset(t.split()) for i, t in titles}
    near = lambda i: len(sets[i] & sets[chains[i]]) / len(sets[i] | sets[chains[i]]) >= 0.5
    want = {i: chains[i] if near(i) else min(j for j, s in sets.items() if s == sets[i]) for i, _ in titles}
    got = {r["id"]: r["cluster"] for r in text.cluster_titles(make(titles, "id int, t string"), "id", "t").collect()}
    assert got == want


def test_linking_folds_a_long_chain(make):
    df = make([(i, [f"s{i}", f"s{i + 1}"]) for i in range(60)], "n int, s array<string>")
    assert {r["root"] for r in link_by_signature(df, "n", F.col("s")).collect()} == {0}


def test_drop_one_char_names(make):
    names = ["rijnland", "rijnlnd", "rijnlant", "rijn", "rijm", "bayern"]
    df = make([(n,) for n in names], "n string")
    got = {r["n"]: r["root"] for r in link_by_signature(df, "n", drop_one_char(F.col("n"))).collect()}
    assert got == {"rijnland": "rijnland", "rijnlnd": "rijnland", "rijnlant": "rijnland", "rijn": "rijn", "rijm": "rijm", "bayern": "bayern"}


def test_alias_triple_resolves(make):
    seen = make([("Rood Zaden",)] * 5 + [("Rood Zaden B.V.",)] * 2 + [("RZ",)] + [("Rood Zadem",)] + [("Blue Farms",)] + [(None,)], "name string")
    known = make([("RZ", "Rood Zaden")], "alias string, canonical string")
    got = {r["name"]: r["canonical"] for r in text.resolve_entities(seen, "name", known).collect()}
    assert got == {"Rood Zaden": "Rood Zaden", "Rood Zaden B.V.": "Rood Zaden", "RZ": "Rood Zaden", "Rood Zadem": "Rood Zaden", "Blue Farms": "Blue Farms"}


def test_clean_drops_junk_and_relabels(make):
    df = make([(1, "Menu", "en"), (2, "Ціни ростуть", "en"), (3, "Prix du blÃ©", "fr")], "id int, title string, lang string")
    assert rows(text.clean(df)) == [(2, "Ціни ростуть", "uk"), (3, "Prix du blé", "fr")]


def test_entity_tags_with_stop_terms(make):
    docs = make([(1, "Pepper growers: Red Star wins, red star grows. Pepper!"), (2, "nothing here"), (3, "")], "id int, t string")
    terms = make([("red star", "Red Star Seeds"), ("pepper", "Pepper")], "term string, entity string")
    stop = make([("pepper",)], "term string")
    assert rows(text.tag_entities(docs, "id", "t", terms, stop, upto=2)) == [(1, "red star", "Red Star Seeds", 2)]
    assert rows(text.tag_entities(docs, "id", "t", terms, None, upto=1)) == [(1, "pepper", "Pepper", 2)]


@pytest.mark.parametrize("batch", [2, 64])
def test_topk_cosine_against_numpy(make, monkeypatch, batch):
    monkeypatch.setattr(text, "QUERY_BATCH", batch)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(50, 8))
    corpus = make([(i, [float(x) for x in v]) for i, v in enumerate(base)], "vec_id int, embedding array<double>")
    queries = corpus.filter("vec_id < 5").withColumnRenamed("vec_id", "query_id")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in text.topk_cosine_many(queries, corpus, 3).collect()}
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    sims = unit @ unit.T
    assert got == {(q, k + 1): int(i) for q in range(5) for k, i in enumerate(np.argsort(-sims[q])[:3])}
    assert [r["vec_id"] for r in text.topk_cosine(corpus, list(base[3]), 2).collect()] == [int(i) for i in np.argsort(-sims[3])[:2]]


def test_approximate_retrieval_finds_most_of_the_exact_answer(make):
    rng = np.random.default_rng(3)
    corpus = make([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(200, 8)))], "vec_id int, embedding array<double>").cache()
    hits = 0
    for q in (0, 50, 100):
        vector = corpus.filter(F.col("vec_id") == q).first()["embedding"]
        exact = {r["vec_id"]: r["similarity"] for r in text.topk_cosine(corpus, vector, 5).collect()}
        near = {r["vec_id"]: r["similarity"] for r in text.approx_topk_cosine(corpus, vector, 5).collect()}
        assert near[q] == pytest.approx(1.0, abs=1e-6)
        hits += len(set(exact) & set(near))
    assert hits >= 12


def test_titles_and_hosts(make):
    df = make([("<head><TITLE lang='x'>\n A  b </TITLE>", "https://m.Example.org:80/x")], "h string, u string")
    assert rows(df.select(text.title_of("h"), text.host_of("u"))) == [("A b", "m.example.org")]


def test_chains_do_not_carry_a_story_or_a_name(make):
    titles = [(1, "acme buys farm"), (2, "acme sells farm"), (3, "acme sells tractor")]
    got = {r["id"]: r["cluster"] for r in text.cluster_titles(make(titles, "id int, t string"), "id", "t").collect()}
    assert got[3] == 3 and len(set(got.values())) >= 2
    names = ["Co.", "Inc", "!!!", "???", "Agri 11", "Agri 12", "Agri 23", "AS Roma", "Roma A/S", "Cookie Farm"]
    out = {r["n"]: r["canonical"] for r in text.resolve_entities(make([(n,) for n in names], "n string"), "n").collect()}
    assert out == {n: n for n in names}


def test_headlines_are_no_junk(make):
    df = make([(1, "Cookie maker buys farm"), (2, "Accept all cookies"), (3, "Auction house fined"), (4, "Lot 12")], "id int, title string")
    assert [r["id"] for r in df.filter(~is_junk_title("title")).collect()] == [1, 3]
