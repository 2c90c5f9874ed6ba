import hashlib
import re
from collections import defaultdict

import pytest

from bizlens.llm import exact_dedup
from tests.llm.conftest import ODD


def brute(pairs):
    groups = defaultdict(list)
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in pairs]
    for (i, _), t in zip(pairs, norm):
        groups[t].append(i)
    out = []
    for (i, _), t in zip(pairs, norm):
        ids = [x for x in groups[t] if x is not None]
        out.append((i, min(ids) if ids else None, len(groups[t]), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [64, 3])
def test_equals_brute_force_also_when_chunk_hashes_collide(docs_of, bits):
    long = [(20 + k, " ".join(f"word{(j * j + k // 2) % 97} nor in" for j in range(900))) for k in range(6)]
    pairs = ODD + long
    got = exact_dedup.exact_dedup(docs_of(pairs), bits=bits).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=repr) == brute(pairs)
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_chunks_join_to_the_text(docs_of):
    pairs = [(1, "one nor two, " * 2000), (2, "q" * 10_000)]
    for row in exact_dedup.chunk_table(docs_of(pairs)).collect():
        assert "".join(row.chunks) == dict(pairs)[row.doc_id] and len(row.chunks) > 1


def test_empty_table(docs_of):
    assert exact_dedup.exact_dedup(docs_of([])).count() == 0
