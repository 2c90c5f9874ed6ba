"""Byte-level BPE encoding with a contiguous rank array, and decoding.

A word is short, so its part boundaries and the rank of each adjacent pair are held in two flat lists: find the
smallest rank, delete the boundary behind it, look up the two ranks beside it again, until no pair has a rank.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from bizlens.llm.common import keyed

#: Fixed values of the vocabulary file: the pattern that splits text into words before merging.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same pattern where a text has only these characters, for the faster of the two regular expression modules.
LATIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
LATIN_WORDS = re.compile(WORDS.replace(r"[^\s\p{L}\p{N}]", r"[^\t-\r A-Za-z0-9À-ÿ]").replace(r"\p{L}", r"[A-Za-zÀ-ÿ]")
                         .replace(r"\p{N}", "[0-9]").replace(r"\s", r"[\t-\r ]").replace(r"\S", r"[^\t-\r ]"))
#: Words whose ids a worker remembers; a bound on memory only.
CACHE_WORDS = 400_000
#: Words longer than this are merged with a heap, as scanning the array would be quadratic.
SHORT = 256
NO_RANK = 1 << 30


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class BytePairs:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.ranks, self.made = {}, []
        for rank, merge in enumerate(merges):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks[vocab[left], vocab[right]] = rank
            self.made.append(vocab[left + right])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.single = {letters[k]: v for k, v in vocab.items() if len(k) == 1}
        self.bytes = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, k in vocab.items():
            if token not in self.special:
                self.bytes[k] = bytes(letters[c] for c in token)
        for token, k in self.special.items():
            self.bytes[k] = token.encode()
        self.words = regex.compile(WORDS)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one short word."""
        single, ranks, made = self.single, self.ranks, self.made
        parts = [single[b] for b in word]
        pair = [ranks.get(p, NO_RANK) for p in zip(parts, parts[1:])]
        while pair:
            best = min(pair)
            if best == NO_RANK:
                break
            at = pair.index(best)
            parts[at] = made[best]
            del parts[at + 1], pair[at]
            if at:
                pair[at - 1] = ranks.get((parts[at - 1], parts[at]), NO_RANK)
            if at < len(pair):
                pair[at] = ranks.get((parts[at], parts[at + 1]), NO_RANK)
        return parts

    def merge_long(self, word: bytes) -> list[int]:
        """As ``merge``, in n log n."""
        parts, ranks = [self.single[b] for b in word], self.ranks
        n = len(parts)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(ranks[p], k, p) for k, p in enumerate(zip(parts, parts[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            rank, k, p = heapq.heappop(heap)
            j = after[k]
            if not alive[k] or j >= n or (parts[k], parts[j]) != p:
                continue
            parts[k], alive[j], after[k] = self.made[rank], False, after[j]
            if after[j] < n:
                before[after[j]] = k
            for a in (before[k], k):
                if a >= 0 and after[a] < n and (q := (parts[a], parts[after[a]])) in ranks:
                    heapq.heappush(heap, (ranks[q], a, q))
        return [parts[k] for k in range(n) if alive[k]]

    def word(self, word: str) -> bytes:
        raw = word.encode("utf-8", "replace")
        ids = np.array(self.merge(raw) if len(raw) <= SHORT else self.merge_long(raw), "<u4").tobytes()
        if len(self.known) < CACHE_WORDS and len(raw) <= 64:
            self.known[word] = ids
        return ids

    def plain(self, text: str) -> bytes:
        """Ids of text without special tokens, as little-endian 32-bit words."""
        words = LATIN_WORDS.findall(text) if LATIN.fullmatch(text) else self.words.findall(text)
        get, word = self.known.get, self.word
        return b"".join([get(w) or word(w) for w in words])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit words; special tokens in the text are found first."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.plain(text)
        return b"".join([np.uint32(self.special[part]).tobytes() if part in self.special else self.plain(part) for part in self.cut.split(text)])

    def decode(self, ids: bytes) -> str:
        pieces = self.bytes
        return b"".join([pieces[k] for k in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


@functools.cache
def byte_pairs(path: str) -> BytePairs:
    """One per worker process, so what it remembers lasts over tasks."""
    return BytePairs(path)


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_output: bool = False) -> DataFrame:
    """Per row: ``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``; ``with_output`` adds ``ids`` and ``decoded``.

    A null text counts as empty (no ids). Rows are independent, so repeated rows, ties and null ids give a row each;
    an empty table gives an empty table; other columns are not read. No row moves between tasks.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_output else "")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = byte_pairs(vocabulary)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = pairs.encode(text)
                back = pairs.decode(ids)
                row = (doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
                out.append((*row, np.frombuffer(ids, "<u4").astype("int32"), back) if with_output else row)
            names = [c.split()[0] for c in schema.split(", ")]
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    return keyed(docs, id_col, text_col).mapInPandas(work, schema)
