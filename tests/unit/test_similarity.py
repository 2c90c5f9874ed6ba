import random

import pytest

from bizlens.operators.similarity import edit_pairs, gram_size, jaccard_pairs
from bizlens.plans import text


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def random_sets(seed, n=120):
    rnd = random.Random(seed)
    base = [[f"t{rnd.randrange(30)}" for _ in range(rnd.randrange(1, 9))] for _ in range(25)]
    out = []
    for k in range(n):
        words = list(rnd.choice(base))
        for _ in range(rnd.randrange(3)):
            if words and rnd.random() < 0.5:
                words.pop(rnd.randrange(len(words)))
            else:
                words.append(f"t{rnd.randrange(40)}")
        out.append((k, words + ["hot"]))
    return out + [(500, []), (None, ["t1", "hot"]), (501, [None, "t1", "hot"])]


@pytest.mark.parametrize("pct", [50, 80, 34, 100])
def test_jaccard_pairs_equal_all_pairs(spark, pct):
    sets = random_sets(pct)
    df = spark.createDataFrame(sets, "id long, w array<string>")
    got = sorted((r.a, r.b) for r in jaccard_pairs(df, "id", "w", pct).collect())
    clean = [(i, {x for x in w if x is not None}) for i, w in sets if i is not None]
    want = sorted((a, b) for a, x in clean for b, y in clean if a < b and x and y and 100 * len(x & y) >= pct * len(x | y))
    assert got == want and len(want) > 0


def random_names(seed, n=150):
    rnd = random.Random(seed)
    base = ["acme", "globex", "initech", "umbrella", "hooli", "ab", "a", "x1", "soylent green", "müller"]
    out = set()
    for _ in range(n):
        s = list(rnd.choice(base))
        for _ in range(rnd.randrange(4)):
            op, at = rnd.randrange(3), rnd.randrange(len(s) + 1)
            if op == 0:
                s.insert(at, rnd.choice("abcxyz1"))
            elif s and at < len(s):
                if op == 1:
                    s.pop(at)
                else:
                    s[at] = rnd.choice("abcxyz")
        out.add("".join(s))
    return sorted(out) + [""]


@pytest.mark.parametrize("pct", [75, 90, 50, 30])
def test_edit_pairs_equal_all_pairs(spark, pct):
    names = random_names(pct)
    df = spark.createDataFrame([(s,) for s in names] + [(None,), (names[0],)], "s string")
    got = sorted((r.a, r.b) for r in edit_pairs(df, "s", pct).collect())
    want = sorted((a, b) for a in names for b in names if a < b and 100 * lev(a, b) <= (100 - pct) * max(len(a), len(b)))
    assert got == want and len(want) > 0
    assert gram_size(pct) == (2 if pct >= 67 else 1)


def test_title_clusters_are_components_of_verified_links(spark):
    rows = [(1, "Big fire in the city"), (2, "big FIRE in the city!"), (3, "Fire in the city"), (4, "fire in town"), (5, None),
            (6, "Stocks fall"), (7, "stocks fall again"), (8, "")]
    df = spark.createDataFrame(rows, "page_id long, title string")
    got = {r.page_id: (r.cluster, r.cluster_size) for r in text.cluster_titles_jaccard(df, "page_id", "title", 50).collect()}
    assert got == {1: (1, 3), 2: (1, 3), 3: (1, 3), 4: (4, 1), 5: (5, 1), 6: (6, 2), 7: (6, 2), 8: (8, 1)}  # "fire in town": 2 of 5 words
    strict = {r.page_id: r.cluster for r in text.cluster_titles_jaccard(df, "page_id", "title", 80).collect()}
    assert strict[3] == 1 and strict[4] == 4 and strict[7] == 7


def test_names_fold_by_edit_similarity_at_any_length(spark):
    rows = [("Acme",), ("Acme",), ("acme inc",), ("Acne",), ("Globex",), ("Glbex",), ("ab",), ("ac",), (None,)]
    df = spark.createDataFrame(rows, "name string")
    got = {r.name: (r.canonical, r.mentions) for r in text.resolve_names_edit(df, "name", 75).collect()}
    assert got == {"Acme": ("Acme", 2), "acme inc": ("Acme", 1), "Acne": ("Acme", 1), "Globex": ("Globex", 1), "Glbex": ("Globex", 1),
                   "ab": ("ab", 1), "ac": ("ac", 1)}
