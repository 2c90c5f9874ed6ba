import numpy as np
import pytest
from xxhash import xxh64_intdigest

from bizlens.llm import rabitq, simhash
from bizlens.llm.components import components
from tests.llm.conftest import FOLDER, ODD


def fingerprint(text, width):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[k:k + width]) for k in range(max(len(words) - width, 0) + 1)] if words else []
    hashes = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def roots(prints, distance):
    v = np.array(prints, np.uint64)
    label = list(range(len(v)))
    for _ in range(len(v)):
        near = np.bitwise_count(v[:, None] ^ v[None, :]) <= distance
        new = [min(label[j] for j in np.flatnonzero(row)) for row in near]
        if new == label:
            return label
        label = new
    return label


@pytest.mark.parametrize("block,distance", [(4096, 4), (3, 4), (4096, 9)])
def test_components_equal_brute_force(spark, docs_of, block, distance):
    pairs = ODD + [(r.doc_id + 100, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs_of(pairs), 4, distance, block=block).collect()), key=repr)
    prints = [fingerprint(t, 4) for _, t in pairs]
    label = roots(prints, distance)
    least = {}
    for (i, _), c in zip(pairs, label):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    assert got == sorted(((i, f"{p:016x}", least.get(c)) for (i, _), p, c in zip(pairs, prints, label)), key=repr)


@pytest.mark.parametrize("total", [100, 10**6, 10**9])
def test_plan_satisfies_the_pigeonhole(total):
    sample = np.random.default_rng(0).integers(0, 1 << 63, 2000, dtype=np.uint64) & np.uint64(0xFFFF0FFFFFFFFFF7)
    parts = simhash.plan(sample, total, 4)
    bits = [b for p in parts for b in p.bits]
    assert len(bits) == len(set(bits)) and sum(p.threshold + 1 for p in parts) == 5
    rng = np.random.default_rng(1)
    for _ in range(300):
        change = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(bin(change & p.mask & (1 << 64) - 1).count("1") <= p.threshold for p in parts)


def test_components_of_chains(make):
    links = [(k, k + 1) for k in range(50)] + [(100, 99), (99, 101), (7, 7)]
    got = {r.node: r.root for r in components(make(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(51)}, 99: 99, 100: 99, 101: 99}


def test_no_documents(docs_of):
    assert simhash.near_duplicates(docs_of([])).count() == 0


def exact(vectors, asked, k):
    out = []
    for q, v in asked.items():
        ranked = sorted(((-float(np.dot(np.array(w), np.array(v))), i) for i, w in vectors.items() if i != q and len(w) == len(v)))[:k]
        out += [(q, r + 1, i) for r, (_, i) in enumerate(ranked)]
    return sorted(out)


def test_nearest_with_ties_and_odd_vectors(make):
    rng = np.random.default_rng(2)
    rows = {k: (rng.standard_normal(16) * rng.uniform(0.5, 2)).round(3).tolist() for k in range(400)}
    rows |= {400 + k: rows[3] for k in range(60)} | {900: [1.0, 2.0], 901: [2.0, 1.0], 920: [0.5, 0.5]}
    odd = [(500, None), (501, [0.0] * 16), (502, [float("nan")] + [1.0] * 15), (503, [float("inf")] * 16), (504, [None] + [1.0] * 15), (None, [1.0] * 16), (505, [])]
    df = make([(i, v, "x", 1) for i, v in [*rows.items(), *odd, (0, rows[0])]], "vec_id long, embedding array<double>, code string, norm int")
    got = rabitq.nearest(df, df.filter("vec_id % 20 = 0"), 20).collect()
    want = exact(rows, {i: v for i, v in rows.items() if i % 20 == 0}, 20)
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == want
    for r in got:
        assert abs(r.score - np.dot(rows[r.query_id], rows[r.vec_id])) < 1e-9


def test_recall_in_blocks(spark, monkeypatch):
    df = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    monkeypatch.setattr(rabitq, "INDEX_BLOCK", 100)
    monkeypatch.setattr(rabitq, "QUERY_BLOCK", 7)
    got = {(r.query_id, r.vec_id) for r in rabitq.nearest(df, df.filter("vec_id % 20 = 0"), 20).collect()}
    rows = {r.vec_id: r.embedding for r in df.collect()}
    want = {(q, i) for q, _, i in exact(rows, {i: v for i, v in rows.items() if i % 20 == 0}, 20)}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


def test_estimates_stay_within_their_bound():
    rng = np.random.default_rng(4)
    v, q = rng.standard_normal((2000, 64)), rng.standard_normal(64)
    code, norm, factor = rabitq.encode(v)
    signs = (np.unpackbits(code, axis=1) * 2.0 - 1) / 8
    guess = signs @ (rabitq.rotation(64) @ q) * norm / factor
    slack = rabitq.EPSILON * norm * np.linalg.norm(q) * np.sqrt(1 - factor**2) / factor / np.sqrt(63)
    assert (np.abs(guess - v @ q) <= slack).mean() > 0.99


def test_no_vectors(make):
    df = make([], "vec_id long, embedding array<float>")
    assert rabitq.nearest(df, df, 20).count() == 0
