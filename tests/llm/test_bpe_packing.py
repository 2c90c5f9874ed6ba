import hashlib
import itertools
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from bizlens.llm import bpe, packing
from bizlens.llm.registry import vocabulary
from tests.llm.conftest import FOLDER, ODD

BYTE, WORD = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")


@pytest.fixture(scope="module")
def byte_tokenizer():
    return Tokenizer.from_file(BYTE)


def test_bpe_equals_the_library(spark, docs_of, byte_tokenizer):
    more = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    pairs = ODD + [(k + 1000, t) for k, t in more]
    got = bpe.encode_decode(docs_of(pairs), BYTE).collect()
    want = []
    for i, t in pairs:
        ids = byte_tokenizer.encode(t or "", add_special_tokens=False).ids
        back = byte_tokenizer.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert sorted([tuple(r) for r in got], key=repr) == sorted(want, key=repr)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdeé'sStll  \n\t\x1c\x85\xa0 0129½²ªß.,!?-日́퟿<|endoftext|>"), max_size=40))
def test_any_text_encodes_as_the_library_does(text):
    pairs = bpe.byte_pairs(BYTE)
    ids = np.frombuffer(pairs.encode(text), "<u4").tolist()
    assert ids == _lib().encode(text, add_special_tokens=False).ids
    assert pairs.decode(pairs.encode(text)) == text


_CACHE = {}


def _lib(path=BYTE):
    return _CACHE.setdefault(path, Tokenizer.from_file(path))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aBcdEÉé'sSTll  \n\t\x1c\x85\xa0 0129½²ªß.,!?-日́HİΣẖ<|endoftext|>"), max_size=40))
def test_word_ids_equal_the_library(text):
    assert np.frombuffer(packing.word_ids(WORD).encode([text])[0], "<u4").tolist() == _lib(WORD).encode(text, add_special_tokens=False).ids


def test_long_words_merge_alike():
    pairs = bpe.byte_pairs(BYTE)
    for raw in (b"ab" * 600, b"the" * 300 + b"zq" * 100, bytes(range(256)) * 3):
        assert pairs.merge(raw) == pairs.merge_long(raw)


def check_packing(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("capacity", [4096, 7])
def test_packing_is_whole_and_gapless(docs_of, capacity):
    got = packing.pack(docs_of(ODD), WORD, capacity).collect()
    want = []
    for i, t in ODD:
        ids = np.array(_lib(WORD).encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(i, k // capacity, k, len(ids[k:k + capacity]), zlib.crc32(ids[k:k + capacity].tobytes())) for k in range(0, len(ids), capacity)]
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=repr) == sorted(want, key=repr)
    assert check_packing(got, capacity) >= -(-sum(r.length for r in got) // capacity)


def test_fullest_is_the_best_subset():
    rng = np.random.default_rng(1)
    for _ in range(200):
        lengths = rng.integers(1, 12, 6).tolist()
        room = int(rng.integers(1, 30))
        counts = {k: lengths.count(k) for k in lengths}
        used = packing.fullest(counts, room, sorted(counts, reverse=True))
        best = max(sum(c) for n in range(7) for c in itertools.combinations(lengths, n) if sum(c) <= room)
        assert sum(k * n for k, n in used.items()) == best and all(counts[k] >= n for k, n in used.items())


def test_empty_tables(docs_of):
    assert packing.pack(docs_of([]), WORD).count() == 0
    assert bpe.encode_decode(docs_of([]), BYTE).count() == 0
