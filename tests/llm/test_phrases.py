import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from bizlens.llm import phrases
from tests.llm.conftest import ODD


def brute(rows, least, top):
    """Every count and rule of the contract, on Python strings."""
    f, n = {}, Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        low = re.sub(r"[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for size in range(1, 6):
                for i in range(len(words) - size + 1):
                    key = (lang, " ".join(words[i:i + size]))
                    f[key] = f.get(key, 0) + 1
    cand = {k: a for k, a in f.items() if 2 <= len(k[1].split(" ")) <= 5 and a >= least}
    out = {}
    for (lang, p), a in cand.items():
        w = p.split(" ")
        inside = any(q[0] == lang and len(q[1].split(" ")) > len(w) and f" {p} " in f" {q[1]} " and b >= a for q, b in cand.items())
        if inside:
            continue
        best = None
        for k in range(1, len(w)):
            l, r = f[(lang, " ".join(w[:k]))], f[(lang, " ".join(w[k:]))]
            s = 1000 * a * n[lang] // (l * r)
            if best is None or s < best[0]:
                best = (s, l, r)
        out.setdefault(lang, []).append((p, a, best[1], best[2], n[lang], best[0]))
    rows = []
    for lang, items in out.items():
        items.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        rows += [(lang, i + 1, *x) for i, x in enumerate(items[:top])]
    return sorted(rows)


def corpus(seed):
    rnd = random.Random(seed)
    vocab = ["New", "york", "the", "of", "city", "big", "apple", "über", "naïve", "a%b", "x_y", "café"]
    out = []
    for _ in range(80):
        words = []
        for _ in range(rnd.randrange(0, 40)):
            words.append(rnd.choice(["new york city", "the big apple", "of the", "über naïve", rnd.choice(vocab)]))
        sep = rnd.choice([" ", " \t", ", ", ". ", "\n", " ; "])
        out.append((sep.join(words), rnd.choice(["en", "de", None])))
    return out


@pytest.mark.parametrize("step,flush", [(1 << 20, 1 << 21), (64, 50)])
def test_equals_brute_force(spark, docs_of, step, flush, monkeypatch):
    monkeypatch.setattr(phrases, "FLUSH_ROWS", flush)
    rows = corpus(3) + [(t, "en") for _, t in ODD] + [("new york city " * 50, "en"), ("new york city " * 50, "en")]
    df = spark.createDataFrame([(k, t, lang, 1) for k, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, size int")
    got = phrases.mine(df, least=3, top=7, step=step).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 3, 7)
    assert len(got) > 10


def test_products_beyond_64_bits_and_long_texts(spark):
    text = ("alpha beta. " * 200_000) + "gamma"
    df = spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")
    got = phrases.mine(df, least=100).collect()
    assert [(r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got] == [("alpha beta", 200_000, 200_000, 200_000, 400_001, 1000 * 400_001 // 200_000)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert phrases.mine(df).count() == 0


def test_rare_phrases_of_frequent_pairs_are_not_sent(spark, monkeypatch):
    """Every pair of the 30 words is frequent and nearly all longer phrases are rare: tasks send on less than twice the text
    (before: each 3- to 5-word phrase as a row, 15 times the text)."""
    rnd = random.Random(5)
    rows = [(" ".join(f"word{rnd.randrange(30):03d}" for _ in range(1000)), "en") for _ in range(120)]
    size = sum(len(t) for t, _ in rows)
    df = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    sent = spark.sparkContext.accumulator(0)
    kind = type(df)

    def watched(self, func, schema, *more, f=kind.mapInArrow):
        def tell(batches):
            for b in func(batches):
                sent.add(b.nbytes)
                yield b
        return f(self, tell, schema, *more)

    monkeypatch.setattr(kind, "mapInArrow", watched)
    found, total = phrases.counts(df, least=50)
    got = {(r.phrase, r.f) for r in found.collect()}
    assert sent.value < 2 * size
    f = Counter()
    for t, _ in rows:
        w = t.split(" ")
        f.update(" ".join(w[i:i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    assert got == {(p, n) for p, n in f.items() if n >= 50} and len(got) > 900


def same_code(seed):
    """Two words of 16 bytes with one code under the seed of ``en``: the second half undoes what the first half differs in."""
    rnd = random.Random(1)
    letters = [b for b in range(33, 127) if not 65 <= b <= 90 and chr(b) not in ".,;:!?"]
    start = phrases.mixed(np.array([(seed + 16) % 2**64], np.uint64))
    while True:
        one, two = ([rnd.choice(letters) for _ in range(8)] for _ in range(2))
        apart = [int(phrases.mixed(start ^ np.frombuffer(bytes(x), "<u8"))[0]) for x in (one, two)]
        other = list((apart[0] ^ apart[1]).to_bytes(8, "little"))
        halves = [[b for b in letters if b ^ x in letters] for x in other]
        if all(halves):
            half = [h[0] for h in halves]
            return bytes(one + half).decode(), bytes(two + [b ^ x for b, x in zip(half, other)]).decode()


def test_words_with_one_code_are_told_apart(spark):
    seed = phrases.seed_of("en", 0)
    a, b = same_code(seed)
    codes = phrases.codes_of(pa.array([a, b, "x"]), np.full(3, seed, np.uint64))
    assert a != b and codes[0] == codes[1] != codes[2]
    rows = [(f"{a} {b} x, {b} x y" if k % 3 else f"{a} x", "en") for k in range(30)]
    df = spark.createDataFrame(rows, "text string, lang string")
    got = phrases.mine(df, least=10, top=50).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 10, 50) and len(got) > 2


def test_codes_of_words_of_any_length():
    words = ["", "a", "ab", "ba", "12345678", "123456789", "x" * 511, "x" * 512, "x" * 513, "x" * 5000, "x" * 4999 + "y", "é", "a\0", "a\0\0"]
    codes = phrases.codes_of(pa.array(words), np.full(len(words), 7, np.uint64))
    assert len(set(codes)) == len(words)
    assert list(codes[3:7]) == list(phrases.codes_of(pa.array(words)[3:7], np.full(4, 7, np.uint64)))


@pytest.mark.parametrize("base", [3, 1 << 14, 1 << 31])
def test_summed_rows_of_numbers_beyond_64_bits(base):
    rnd = random.Random(base)
    some = [rnd.randrange(base) for _ in range(4)] + [0, base - 1]
    rows = [tuple(rnd.choice(some) for _ in range(5)) for _ in range(3000)] * 2
    columns, weights = [np.array(c, np.int64) for c in zip(*rows)], np.arange(len(rows))
    for w, want in ((None, Counter(rows)), (weights, Counter())):
        if w is not None:
            for r, x in zip(rows, weights.tolist()):
                want[r] += x
        numbers, count = phrases.summed(columns, base, w)
        got = list(zip(*(c.tolist() for c in numbers)))
        assert got == sorted(got) and dict(zip(got, count.tolist())) == dict(want)
