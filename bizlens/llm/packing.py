"""Best-fit packing by minimum bin slack.

Only the histogram of piece lengths (at most ``capacity`` rows) decides how bins are filled: for each bin a bitset
subset-sum over the lengths still there finds the fullest combination with the longest piece, and the combination is
taken as often as its lengths last. Pieces then look up their place by their rank among the pieces of one length.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bizlens.llm.common import keyed, stored

CAPACITY = 4096
END_ID = 1
#: Words whose ids a task remembers; a bound on memory only, words beyond it are encoded again.
CACHE_WORDS = 400_000
DOCS_AT_ONCE = 500


def fullest(counts: dict[int, int], room: int, most: list[int]) -> dict[int, int]:
    """The multiset of available lengths with the largest sum up to ``room``: ``{length: copies}``.

    ``most`` lists the available lengths, longest first. The bitset holds the reachable sums; one bitset per step is
    kept to walk back. The first exact fill ends the search.
    """
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in most:
        if length > room:
            continue
        left, k = min(counts[length], room // length), 1
        while left > 0:
            take = min(k, left)
            steps.append((reach, length, take))
            reach = (reach | reach << (length * take)) & mask
            left, k = left - take, k * 2
        if reach >> room:
            break
    total, used = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + take
            total -= length * take
    return used


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(how many bins, {length: copies in each}) for the whole histogram, in order of bin numbers."""
    counts = {k: n for k, n in histogram.items() if n > 0}
    plan = []
    while counts:
        lengths = sorted(counts, reverse=True)
        longest = lengths[0]
        counts[longest] -= 1
        used = fullest(counts, capacity - longest, lengths)
        counts[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        bins = min(counts[k] // n for k, n in used.items())
        for k, n in used.items():
            counts[k] -= n * bins
            if not counts[k]:
                del counts[k]
        plan.append((bins, used))
    return plan


#: Fixed values of the vocabulary file: its words, once a text of only these characters is in lower case.
LATIN = re.compile(r"[\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
LATIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00ff]+|[0-9]|[^\t-\r a-z0-9\u00df-\u00ff]+")


class WordIds:
    """Ids of texts as little-endian 32-bit words, each distinct word encoded by the tokenizer once and remembered.

    The tokenizer drops white space, so no token spans it. A text of Latin letters is cut further into the
    words of the vocabulary's own pattern after lower-casing; any other text, and one that may hold a special token, only
    at ASCII white space.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, bytes] = {}

    @staticmethod
    def words(text: str) -> list[str]:
        if "<|" not in text and LATIN.fullmatch(text):
            return LATIN_WORDS.findall(text.lower())
        return re.split(r"[\t-\r ]+", text)

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.words(t) for t in texts]
        new = list(set().union(*cut).difference(self.known))
        found = self.tokenizer.encode_batch_fast([w.encode("utf-8", "replace").decode() for w in new], add_special_tokens=False)
        fresh = {w: np.array(x.ids, "<u4").tobytes() for w, x in zip(new, found)}
        get = self.known.get
        out = [b"".join([x if (x := get(w)) is not None else fresh[w] for w in words]) for words in cut]
        if len(self.known) < CACHE_WORDS:
            self.known.update((w, x) for w, x in fresh.items() if len(w) <= 64)
        return out


@functools.cache
def word_ids(path: str) -> WordIds:
    """One per worker process, so what it remembers lasts over tasks."""
    return WordIds(path)


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written once: ``row`` (number of the document's row), ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, end, step = word_ids(vocabulary), np.uint32(END_ID).tobytes(), 4 * capacity
        for batch in batches:
            for lo in range(0, len(batch), DOCS_AT_ONCE):
                some, out = batch.iloc[lo:lo + DOCS_AT_ONCE], []
                for row, doc_id, ids in zip(some["row"], some["doc_id"], words.encode(some["text"].tolist())):
                    ids += end
                    out += [(row, doc_id, k, at // 4, (min(at + step, len(ids)) - at) // 4, zlib.crc32(ids[at:at + step]))
                            for k, at in enumerate(range(0, len(ids), step))]
                yield pd.DataFrame(out, columns=["row", "doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    rows = keyed(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return stored(rows.mapInPandas(cut, "row long, doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``sequence_id`` and ``offset`` for each piece.

    Ranks within a length come from counts per length and writing task plus a window inside both, so the pieces of a
    very frequent length never meet in one task. The plan has fewer rows than a small multiple of ``capacity``.
    """
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places: dict[int, list[tuple[int, int, int, int]]] = {}
    ranked: dict[int, int] = {}
    first_bin = 0
    for bins, used in plan_bins(histogram, capacity):
        offset = 0
        for length, copies in sorted(used.items(), reverse=True):
            start = ranked.get(length, 0)
            places.setdefault(length, []).append((start, copies, first_bin, offset))
            ranked[length] = start + copies * bins
            offset += copies * length
        first_bin += bins
    lookup = {k: np.array(v, np.int64) for k, v in places.items()}

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seq, off = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for length, at in batch.groupby("length").indices.items():
                rank, known = batch["rank"].to_numpy()[at], lookup[length]
                hit = known[np.searchsorted(known[:, 0], rank, "right") - 1]
                inner = rank - hit[:, 0]
                seq[at] = hit[:, 2] + inner // hit[:, 1]
                off[at] = hit[:, 3] + inner % hit[:, 1] * length
            yield batch.drop(columns="rank").assign(sequence_id=seq, offset=off)

    # The writing task's number is in the high bits of the row number; long tasks are split further by the row's own.
    marked = cut.withColumn("part", F.shiftrightunsigned("row", 12))
    counts = marked.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length", F.shiftrightunsigned("part", 10))
    blocks = counts.groupBy("length", F.shiftrightunsigned("part", 10).alias("block")).agg(F.sum("n").alias("m"))
    blocks = blocks.withColumn("ahead", F.coalesce(F.sum("m").over(
        Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("m")
    counts = counts.withColumn("base", F.coalesce(F.sum("n").over(before.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    counts = counts.withColumn("block", F.shiftrightunsigned("part", 10)).join(blocks, ["length", "block"])
    counts = counts.select("length", "part", (F.col("base") + F.col("ahead")).alias("base"))
    local = F.row_number().over(Window.partitionBy("length", "part").orderBy("row", "piece")) - 1
    ranks = marked.withColumn("local", local).join(counts, ["length", "part"])
    ranks = ranks.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("local")).alias("rank"))
    return ranks.mapInPandas(assign, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A null or empty text has the end id only. Repeated rows are documents of their own, also with one id or a null id.
    A document longer than ``capacity`` is cut into full pieces and a rest; the pieces of others are whole. An empty
    table gives an empty table; other columns are not read.
    """
    return place(pieces(docs, vocabulary, capacity, id_col, text_col), capacity)
