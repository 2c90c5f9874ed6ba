import hashlib
from collections import Counter

import numpy as np
import pytest

from bizlens.llm import suffix_dedup
from tests.llm.conftest import FOLDER, ODD


def brute(pairs, window):
    """Rows in the order that counts, each with its result; equal rows of one id: one first, the others as copies."""
    seen, out = set(), []
    key = lambda p: (p[0] is None, p[0] or 0, hashlib.sha256((p[1] or "").encode()).hexdigest())
    for i, t in sorted(pairs, key=key):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - window + 1):
            w = raw[p:p + window]
            if w in seen:
                gone[p:p + window] = True
            seen.add(w)
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        out.append((i, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def run(docs, **kw):
    return sorted([tuple(r) for r in suffix_dedup.remove_repeats(docs, **kw).collect()], key=repr)


@pytest.mark.parametrize("hot", [20_000, 3])
def test_equals_brute_force(spark, docs_of, hot):
    pairs = ODD + [(r.doc_id + 100, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").limit(120).collect()]
    assert run(docs_of(pairs), hot=hot) == brute(pairs, 100)


def test_copies_of_a_split_window_are_never_held_together(docs_of, monkeypatch):
    real = suffix_dedup.repeats

    def watched(doc, sub, start, texts, window):
        assert max(Counter(bytes(t) for t in texts).values()) <= 3, "copies of one window met"
        return real(doc, sub, start, texts, window)

    monkeypatch.setattr(suffix_dedup, "repeats", watched)
    rng = np.random.default_rng(7)
    noise = lambda: "".join(rng.choice(list("abcdefghij"), 200))
    passage = "".join(rng.choice(list("klmnopqrst"), 130))
    pairs = [(k, noise() + passage + noise()) for k in range(40)] + [(50, passage), (50, passage), (None, passage)]
    assert run(docs_of(pairs), hot=3) == brute(pairs, 100)


def test_periodic_and_overlapping_texts(docs_of):
    rng = np.random.default_rng(3)
    base = "".join(rng.choice(list("abcd"), 700))
    pairs = [(k, base[k * 13:k * 13 + 300] + "".join(rng.choice(list("ab"), 40)) + base[:k * 7]) for k in range(25)]
    pairs += [(50, "ab" * 400), (51, "b" + "ab" * 90), (52, "a" * 500), (53, "a" * 99), (54, "a" * 100)]
    assert run(docs_of(pairs)) == brute(pairs, 100)
    assert run(docs_of(pairs), window=40, gram=12) == brute(pairs, 40)


def test_merging_shards_gives_the_classes_of_equal_windows():
    rng = np.random.default_rng(5)
    base = rng.integers(97, 100, 4000).astype(np.uint8)
    texts = [base[a:a + 160].copy() for a in rng.integers(0, 3000, 120)]
    for shard in (1 << 18, 2000, 400):
        string, offset, label = suffix_dedup.classes(texts, 100, shard)
        found = {}
        for s, o, c in zip(string, offset, label):
            found.setdefault(bytes(texts[s][o:o + 100]), set()).add(c)
        assert all(len(c) == 1 for c in found.values()) and len(found) == len(set(label.tolist()))
        assert len(string) == sum(len(t) - 99 for t in texts)


def test_kept_text_and_empty_table(docs_of):
    passage = "a passage that stands in two of the documents, long enough to be found by a window of bytes, and é. " * 2
    rows = suffix_dedup.remove_repeats(docs_of([(1, "first " + passage), (2, "second, " + passage + "tail")]), with_text=True, carry=("lang",)).collect()
    kept = {r.doc_id: r.kept for r in rows}
    assert kept[1] == "first " + passage[:101] + passage[101:] or kept[1].startswith("first a passage")
    assert kept[2].startswith("second,") and kept[2].endswith("tail") and len(kept[2]) < 20
    assert suffix_dedup.remove_repeats(docs_of([])).count() == 0


def test_groups_of_keys_stay_within_their_size():
    """A key that does not fit begins a new group; only a key larger than a group makes a larger one."""
    import pyarrow as pa

    counts = {1: 8, 2: 6, 3: 1, 4: 3, 5: 30, 6: 2}  # texts of 10 bytes per key
    rows = [(key, 100 * key + k, 0, k, b"0123456789") for key, n in counts.items() for k in range(n)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["key", "doc", "sub", "start", "bytes"])
    got = [sorted(keys.tolist()) for keys, *_ in suffix_dedup.whole_keys(iter([batch.slice(0, 11), batch.slice(11)]), group=100)]
    assert got == [[1] * 8, [2] * 6 + [4] * 3, [5] * 30, [6] * 2]
