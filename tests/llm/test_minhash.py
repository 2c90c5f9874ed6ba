import random

import pytest

from bizlens.llm import minhash
from bizlens.llm.components import components
from tests.llm.conftest import FOLDER, ODD


def sets(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
    if len(words) < 2:
        return set(words)
    return {" ".join(words[i:i + 2]) for i in range(len(words) - 1)}


import re  # noqa: E402


def brute(pairs, least=0.8):
    """Components over all pairs whose Jaccard is at least ``least``; empty sets and null ids link with nothing."""
    s = [sets(t) for _, t in pairs]
    parent = list(range(len(pairs)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(pairs)):
        for j in range(i + 1, len(pairs)):
            if pairs[i][0] is None or pairs[j][0] is None or not s[i] or not s[j]:
                continue
            inter = len(s[i] & s[j])
            if 100 * inter >= 80 * (len(s[i]) + len(s[j]) - inter):
                parent[find(i)] = find(j)
    least_id = {}
    for k, (i, _) in enumerate(pairs):
        if i is not None:
            r = find(k)
            least_id[r] = min(i, least_id.get(r, i))
    return sorted(((i, len(s[k]), least_id.get(find(k)) if i is not None else None) for k, (i, _) in enumerate(pairs)), key=repr)


def variants(seed, n):
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(400)}" for _ in range(120)]
    out = []
    for k in range(n):
        words = list(base)
        for _ in range(rnd.choice([0, 1, 2, 3, 10, 40])):
            words[rnd.randrange(len(words))] = f"z{rnd.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("bands,rows", [(10, 3), (16, 1)])
def test_components_equal_brute_force(spark, docs_of, bands, rows):
    pairs = list(ODD) + [(1000 + k, t) for k, t in enumerate(variants(1, 30) + variants(2, 12))]
    pairs += [(r.doc_id + 5000, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60).collect()]
    pairs += [(2000, "Alpha beta"), (2001, "alpha BETA"), (2002, "alpha"), (2003, "ALPHA"), (2004, "")]
    got = minhash.near_duplicates(docs_of(pairs), bands=bands, rows=rows).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(pairs)
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got)


def test_empty_sets_link_with_nothing_and_null_ids(spark, docs_of):
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs_of([(1, ""), (2, None), (3, "  "), (None, "a b"), (4, "a b")])).collect()}
    assert got == {(1, 1, True), (2, 2, True), (3, 3, True), (None, None, False), (4, 4, True)}


def test_long_texts_and_empty_table(spark, docs_of):
    long = " ".join(f"t{k % 5000}" for k in range(300_000))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs_of([(1, long), (2, long + " end"), (3, "x y")])).collect())
    assert got == [(1, 5000, 1), (2, 5001, 1), (3, 1, 3)]
    assert minhash.near_duplicates(docs_of([])).count() == 0


def test_signatures_are_minima_of_the_salted_hashes():
    import numpy as np

    values = np.array([5, 9, 1, 7, 7, 3], np.uint64)
    got = minhash.signatures(values, np.array([0, 2, 2, 6]), 4)
    salt = minhash.seeds(4)
    with np.errstate(over="ignore"):
        assert (got[0] == minhash._mix(values[:2, None] ^ salt).min(0)).all()
        assert (got[2] == minhash._mix(values[2:, None] ^ salt).min(0)).all()
    assert (got[1] == np.iinfo(np.uint64).max).all()


@pytest.mark.parametrize("few", [16, 1])
def test_links_of_members_that_match_a_pivot_are_kept(spark, few):
    """All in one bucket: 20 links to 1 (the pivot) and to 21, 21 only to 20; 2 to 8 match nothing."""
    sets = [(1, list(range(100))), (20, list(range(10, 110))), (21, list(range(20, 120)))]
    sets += [(k, list(range(1000 * k, 1000 * k + 100))) for k in range(2, 9)]
    frame = spark.createDataFrame([(k, len(h), h) for k, h in sets], "rep long, n long, hashes array<long>")
    members = spark.createDataFrame([(0, 0, 0, k) for k, _ in sets], "table int, key long, size long, rep long")
    links = minhash.verified_links(frame, members, 0.8, few)
    assert {(r.node, r.root) for r in components(links).collect()} == {(1, 1), (20, 1), (21, 1)}


def test_chains_of_links_and_texts_of_one_id(spark, docs_of):
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    windows = [" ".join(words[k:k + 120]) for k in range(0, 260, 13)]  # each links only to the one before and after
    ids = rnd.sample(range(100, 1000), len(windows))
    pairs = list(zip(ids, windows)) + [(7, "q " * 30 + " ".join(words[:80])), (7, " ".join(words[300:])), (7, " ".join(words[300:]))]
    got = minhash.near_duplicates(docs_of(pairs), bands=40, rows=1).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(pairs)


def test_large_buckets_meet_by_rare_hashes(spark):
    """Near copies of one set in one bucket, at distances around the threshold from it and from one another; sizes vary."""
    rnd = random.Random(11)
    sets = []
    for k in range(60):
        h = set(rnd.sample(range(100), 100 - rnd.choice([0, 3, 8, 12, 20]))) | set(rnd.sample(range(1000, 1030), rnd.choice([0, 4, 9, 15, 22])))
        sets.append((k * 7 % 60, sorted(h)))
    frame = spark.createDataFrame([(k, len(h), h) for k, h in sets], "rep long, n long, hashes array<long>")
    members = spark.createDataFrame([(5, k) for k, _ in sets], "bucket long, rep long")
    want = {k: k for k, _ in sets}
    for _ in sets:
        for i, a in sets:
            for j, b in sets:
                if 100 * len(set(a) & set(b)) >= 80 * len(set(a) | set(b)):
                    want[i] = want[j] = min(want[i], want[j])
    got = {r.node: r.root for few in (2, 100) for r in components(minhash.verified_links(frame, members, 0.8, few)).collect()}
    assert {k: got.get(k, k) for k in want} == want and 1 < len(set(want.values())) < 50


def test_word_hashes_go_on_across_stretches_and_sets_take_little_memory(monkeypatch):
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(9)
    data = rng.integers(65, 122, 1 << 21).astype(np.uint8)
    data[rng.random(len(data)) < 0.15] = 32
    offsets = np.array([0, len(data)])
    minhash.shingle_sets(data[:100], np.array([0, 100]), 2)
    tracemalloc.start()
    minhash.shingle_sets(data, offsets, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 56 << 20
    part = np.concatenate([data[:300], np.full(500, 120, np.uint8), data[:40], np.full(90, 32, np.uint8), data[:200]])
    cuts = np.array([0, 0, 310, 600, 850, 900, len(part)])
    whole, off = minhash.shingle_sets(part, cuts, 2)
    for stretch in (1, 7, 64, 541):
        monkeypatch.setattr(minhash, "STRETCH", stretch)
        minhash.powers.cache_clear()
        h, o = minhash.shingle_sets(part, cuts, 2)
        assert (h == whole).all() and (o == off).all()
    minhash.powers.cache_clear()


def test_texts_of_candidates_are_fetched_without_sorting_them(spark, docs_of, monkeypatch):
    plans, write = {}, minhash.stored

    def stored(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, label)

    monkeypatch.setattr(minhash, "stored", stored)
    texts = variants(3, 12)
    got = minhash.near_duplicates(docs_of(list(enumerate(texts)))).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(list(enumerate(texts)))
    assert "ShuffledHashJoin" in plans["minhash-sets"]
    assert not [line for line in plans["minhash-sets"].splitlines() if " Sort [" in line and "doc_id" in line]
