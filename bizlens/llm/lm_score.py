"""Language-model scores by online logistic mixing of hashed-context bit predictors, and a unigram base score.

A text is lower-cased (A-Z), read as UTF-8 bytes and ended by one byte that UTF-8 never has. Each bit is predicted from
counts over all learnable documents in several contexts: the last 3, 4 and 6 bytes and the word so far. A
context hashes to a row of 16 counts for the upper half of the next byte and, with that half, to one for the lower; sums of a row's counts
are the zeros and ones seen at each bit. The predictions, as logits, are mixed with weights that
a gate (how often the word so far was seen) selects and that learn from every coded byte; the mix is refined by an
adaptive map from (bit, probability) to what came. Both learn from the first byte of a text to its last; texts of
similar length advance side by side. The sum of the logarithms is the probability of the text.
"""

from __future__ import annotations

import dataclasses
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlens.llm.common import is_space, keyed, lower_ascii, spans, stored, utf8

END = 0xFF
PAD = 8
M0, M1, M2 = np.uint32(0x01000193), np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)
K1, K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Cells of one row of the table that is summed over tasks.
CHUNK = 1 << 16
#: Logits are kept as signed bytes of this many units per nat.
UNIT = 15.0
HALF = 0.1
#: Times that the word so far was seen, at which the next gate begins.
GATES = (1, 4, 16, 64, 256, 1024)
WORD = 0
#: Bytes whose predictions are held at once (a few more where more texts than this are alive).
BATCH = 1 << 20
#: Bytes whose words are hashed at once.
STRETCH = 1 << 16
#: Texts that advance side by side at most; what each learns takes a few KB.
ABREAST = 1 << 14


@dataclasses.dataclass(frozen=True)
class Params:
    """Contexts as (bytes, log2 of rows); 0 bytes means the word so far and stands last. The table's size is fixed by them.

    ``start_weight`` has the first weights of each gate, one per context. With a ``segment``, weights and refinement start anew
    every so many bytes; 0 carries them through the whole text.
    """

    contexts: tuple[tuple[int, int], ...] = ((3, 18), (4, 18), (6, 18), (WORD, 19))
    start_weight: tuple[tuple[float, ...], ...] = (
        (0.6, 0.4, 0.1, 0.0), (0.6, 0.35, 0.15, 0.1), (0.5, 0.35, 0.15, 0.2), (0.45, 0.35, 0.15, 0.3), (0.35, 0.3, 0.2, 0.35),
        (0.25, 0.3, 0.2, 0.4), (0.3, 0.4, 0.3, 0.05))
    rate: float = 0.004
    refine_rate: float = 0.02
    refine_share: float = 0.5
    levels: int = 32
    segment: int = 0
    block_bytes: int = 8 << 20

    @property
    def bases(self) -> list[int]:
        """First cell of each context's table, and the number of cells."""
        return [0, *np.cumsum([16 << rows for _, rows in self.contexts]).tolist()]


def framed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each lower-cased text between PAD zeros and the end byte: the bytes, and where each text begins and ends (with its end byte)."""
    lengths = np.diff(offsets)
    begin = offsets[:-1] + np.arange(len(lengths)) * (PAD + 1) + PAD
    out = np.zeros(len(data) + len(lengths) * (PAD + 1), np.uint8)
    out[np.arange(len(data)) + np.repeat(begin - offsets[:-1], lengths)] = lower_ascii(data)
    out[begin + lengths] = END
    return out, begin, begin + lengths + 1


@functools.lru_cache(1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse, as many as a stretch needs."""
    up, down = np.full(STRETCH + 1, K1, np.uint64), np.full(STRETCH + 1, np.uint64(pow(int(K1), -1, 1 << 64)), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_hash(data: np.ndarray) -> np.ndarray:
    """Hash of the bytes since the last white space or padding, before each position. A stretch goes on with the word that the one before left."""
    up, down = powers()
    out = np.empty(len(data), np.uint64)
    before, length, full = 0, 0, 1 << 64  # hash and bytes of the word so far
    for lo in range(0, len(data), STRETCH):
        part = data[lo:lo + STRETCH]
        n = len(part)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:n], out=prefix[1:])
        start = np.zeros(n + 1, np.int64)
        stop = is_space(part) | (part == 0)
        start[1:] = np.where(stop, np.arange(1, n + 1), 0)
        start = np.maximum.accumulate(start)
        found = (prefix - prefix[start]) * down[start]
        if length:
            open_ = int(np.searchsorted(start, 0, "right"))
            found[:open_] = found[:open_] * np.uint64(pow(int(K1), length, full)) + np.uint64(before)
        out[lo:lo + n] = found[:n]
        before, length = int(found[n]), n - int(start[n]) + (length if start[n] == 0 else 0)
    return out


def word_context(so_far: np.ndarray) -> np.ndarray:
    return (so_far >> np.uint64(32)).astype(np.uint32)


def cells(data: np.ndarray, params: Params, word: np.ndarray | None = None, at: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each context: its number, and the cells (from its own first one) of the upper and lower half of the bytes ``at`` (every byte from PAD on)."""
    now = data[PAD:] if at is None else data[at]
    n = len(now)
    high, low = (now >> 4).astype(np.uint32), (now & 15).astype(np.uint32)
    past, width = np.zeros(n, np.uint32), 0
    for k, (order, rows) in enumerate(params.contexts):
        if order == WORD:
            word = word_context(word_hash(data)) if word is None else word
            context = word[PAD:] if at is None else word[at]
        else:
            for j in range(width + 1, order + 1):
                past = past * M0 + (data[PAD - j:len(data) - j] if at is None else data[at - j])
            width, context = order, past
        shift = np.uint32(32 - rows)
        first = context ^ context >> np.uint32(15)
        first *= M1
        second = (high + np.uint32(1)) * M2
        second += context
        second ^= second >> np.uint32(15)
        second *= M1
        for row, half in ((first, high), (second, low)):
            row >>= shift
            row <<= np.uint32(4)
            row |= half
        yield k, first.astype(np.int64), second.astype(np.int64)


def count_cells(batches: Iterator[pa.RecordBatch], params: Params) -> Iterator[pa.RecordBatch]:
    """Counts of a task's texts, as (chunk of the table, places, counts)."""
    unpacked.cache_clear()  # a worker that scored before still has that model
    total = np.zeros(params.bases[-1], np.uint32)
    for batch in batches:
        data, offsets = utf8(batch.column(0))
        for lo, hi in spans(offsets, 2 << 20):
            text, begin, end = framed(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
            # padding (bytes before PAD and between texts) is counted too: it stands for how a text begins
            for k, first, second in cells(text, params):
                a, b = params.bases[k], params.bases[k + 1]
                once = np.ones(len(first), np.uint32)
                np.add.at(total[a:b], first, once)
                np.add.at(total[a:b], second, once)
    for chunk in range(0, len(total), CHUNK):
        part = total[chunk:chunk + CHUNK]
        place = np.flatnonzero(part)
        if len(place):
            yield pa.RecordBatch.from_arrays([pa.array([chunk // CHUNK], pa.int32()), pa.array([place.astype("<u2").tobytes()], pa.binary()),
                                              pa.array([part[place].astype("<u4").tobytes()], pa.binary())], names=["chunk", "place", "seen"])


def logits(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per cell the four logits, as signed bytes, on the way to its symbol (rows of 16 counts as a binary tree); per row its gate."""
    n = counts.reshape(-1, 16).astype(np.float64)
    out = np.zeros((len(n), 16, 4), np.int8)
    for bit in range(4):
        width = 8 >> bit
        pair = n.reshape(len(n), 1 << bit, 2, width).sum(3)
        logit = np.log((pair[:, :, 1] + HALF) / (pair[:, :, 0] + HALF))
        out[:, :, bit] = np.repeat(np.clip(np.round(logit * UNIT), -127, 127).astype(np.int8), 2 * width, axis=1)
    return out.reshape(-1, 4).view("<u4").ravel(), np.searchsorted(GATES, n.sum(1), "right").astype(np.uint8)


def learn(docs: DataFrame, params: Params, learnable: Column) -> tuple[np.ndarray, np.ndarray]:
    """The logits of all cells and the gates of all rows, from counts over every learnable document; their size depends on ``params`` only."""
    texts = docs.filter(learnable).select("text")
    partial = texts.mapInArrow(lambda b: count_cells(b, params), "chunk int, place binary, seen binary")

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(CHUNK, np.int64)
        for place, seen in zip(rows["place"], rows["seen"]):
            total[np.frombuffer(place, "<u2")] += np.frombuffer(seen, "<u4")
        cell, gate = logits(total)
        return pd.DataFrame({"chunk": [rows["chunk"].iloc[0]], "logits": [cell.tobytes()], "gates": [gate.tobytes()]})

    table, gates = np.zeros(params.bases[-1], "<u4"), np.zeros(params.bases[-1] // 16, np.uint8)
    for row in partial.groupBy("chunk").applyInPandas(merge, "chunk int, logits binary, gates binary").toLocalIterator():
        at = row["chunk"] * CHUNK
        table[at:at + CHUNK] = np.frombuffer(row["logits"], "<u4")[:len(table) - at]
        gates[at // 16:(at + CHUNK) // 16] = np.frombuffer(row["gates"], np.uint8)[:len(gates) - at // 16]
    return table, gates


def score_texts(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, gates: np.ndarray, params: Params) -> np.ndarray:
    """log10 probability of each text."""
    text, begin, end = framed(data, offsets)
    return score_framed(text, begin, end, word_context(word_hash(text)), table, gates, params)


def score_framed(text: np.ndarray, begin: np.ndarray, end: np.ndarray, word: np.ndarray, table: np.ndarray, gates: np.ndarray, params: Params) -> np.ndarray:
    """As ``score_texts``, for texts framed and hashed already. All texts advance together, a stretch of about BATCH bytes at a time."""
    counts = -(-(end - begin) // params.segment) if params.segment else np.ones(len(begin), np.int64)
    doc = np.repeat(np.arange(len(begin)), counts)
    start = begin[doc] + (np.arange(len(doc)) - np.repeat(np.append(0, np.cumsum(counts)[:-1]), counts)) * params.segment
    length = end[doc] - start
    if params.segment:
        length = np.minimum(length, params.segment)
    order = np.argsort(-length, kind="stable")
    start, length, doc = start[order], length[order], doc[order]
    sums = np.zeros(len(doc))
    for at in range(0, len(doc), ABREAST):
        sums[at:at + ABREAST] = score_abreast(text, start[at:at + ABREAST], length[at:at + ABREAST], word, table, gates, params)
    return np.bincount(doc, weights=sums, minlength=len(begin)) / np.log(10.0)


def score_abreast(text: np.ndarray, start: np.ndarray, length: np.ndarray, word: np.ndarray, table: np.ndarray, gates: np.ndarray, params: Params) -> np.ndarray:
    """Natural log probability of the given segments of ``text``, the longest first."""
    state, sums, t, longest = mix_state(len(start), params), np.zeros(len(start)), 0, int(length[0])
    while t < longest:
        steps = min(longest - t, max(1, BATCH // int(np.searchsorted(-length, -t, "left"))))
        # all bytes t, then all bytes t + 1 of the texts that have one, and so on
        alive = np.searchsorted(-length, -np.arange(t, t + steps), "left")
        turn = np.concatenate([start[:m] + (t + j) for j, m in enumerate(alive.tolist())])
        known, gate = np.empty((len(params.contexts), 2, len(turn)), "<u4"), None
        for k, first, second in cells(text, params, word, turn):
            a, b = params.bases[k], params.bases[k + 1]
            np.take(table[a:b], first, out=known[k, 0], mode="clip")
            np.take(table[a:b], second, out=known[k, 1], mode="clip")
            if params.contexts[k][0] == WORD:
                gate = gates[a // 16:b // 16][first >> 4]
        part = mix_segments(text[turn], alive, known.view(np.int8), np.zeros(len(turn), np.uint8) if gate is None else gate, params, state)
        sums[:len(part)] += part
        t += steps
    return sums


def mix_state(n: int, params: Params) -> tuple[np.ndarray, np.ndarray]:
    """Weights and refinement with which ``n`` segments begin: a row of weights per gate and segment; cells by bit, level and segment."""
    weights = np.repeat(np.array(params.start_weight, np.float32), n, axis=0) / np.float32(UNIT)
    centre = np.linspace(-8, 8, params.levels, dtype=np.float32)
    return weights, np.repeat(np.tile(1 / (1 + np.exp(-centre)), 8), n)


def mix_segments(byte: np.ndarray, alive: np.ndarray, known: np.ndarray, gate: np.ndarray, params: Params,
                 state: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Natural log probability of the segments alive; ``byte``, ``known`` and ``gate`` list all their bytes in the order they are coded.
    ``state`` is what they learned before; it learns on."""
    weights, refine = mix_state(int(alive[0]), params) if state is None else state
    levels, n_ctx = params.levels, len(params.contexts)
    n = len(refine) // (8 * levels)
    line, total = np.arange(n, dtype=np.int64), np.zeros(int(alive[0]))
    place = (np.arange(8, dtype=np.int32) * (n * levels))[:, None] + np.arange(n, dtype=np.int32)
    one, share, refine_rate = np.float32(1), np.float32(params.refine_share), np.float32(params.refine_rate)
    rate, scale = np.float32(params.rate / UNIT ** 2), np.float32((levels - 1) / 16)
    middle = np.float32((levels - 1) / 2 + 0.5)
    bits = np.unpackbits(byte[None, :], axis=0)
    lo = 0
    for m in alive.tolist():
        hi = lo + m
        seen = np.empty((n_ctx, 2, 4, m), np.float32)
        seen[...] = known[:, :, 4 * lo:4 * hi].reshape(n_ctx, 2, m, 4).transpose(0, 1, 3, 2)
        seen = seen.reshape(n_ctx, 8, m)
        own = line[:m]
        picked = gate[lo:hi] * np.int64(n) + own
        w = np.ascontiguousarray(weights.take(picked, axis=0, mode="clip").T)
        x = np.einsum("kjm,km->jm", seen, w)
        np.clip(x, -8, 8, out=x)
        p = np.exp(-x)
        p += one
        np.reciprocal(p, out=p)
        bit = bits[:, lo:hi].astype(np.float32)
        error = bit - p
        error *= rate
        w += np.einsum("kjm,jm->km", seen, error)
        weights[picked] = w.T
        x *= scale
        x += middle
        level = x.astype(np.int32)
        level *= n
        level += place[:, :m]
        learned = refine.take(level, mode="clip")
        p += (learned - p) * share
        refine[level] = learned + (bit - learned) * refine_rate
        bit -= one
        bit += p
        total[:m] += np.log(np.abs(bit).prod(0, dtype=np.float64))
        lo = hi
    return total


def framed_words(text: np.ndarray, begin: np.ndarray, so_far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of the framed texts, and its text's number."""
    stop = is_space(text) | (text == 0) | (text == END)
    last = np.flatnonzero(stop[1:] & ~stop[:-1]) + 1
    h = so_far[last] * K2
    return h ^ h >> np.uint64(31), np.searchsorted(begin, last, "right") - 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of the lower-cased texts, and its text's number."""
    hashes, owners = [], []
    for lo, hi in spans(offsets, BATCH):
        text, begin, _ = framed(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
        h, owner = framed_words(text, begin, word_hash(text))
        hashes.append(h)
        owners.append(owner + lo)
    return (np.concatenate(hashes), np.concatenate(owners)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def learnable(id_col: Column) -> Column:
    """Texts that are learned from; those of a null id are."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 7 != 2, F.lit(True))


def word_counts(dealt: DataFrame, buckets: int) -> DataFrame:
    """Per block and bucket of word hashes, how often each distinct word of the block stands in learnable texts of all blocks.

    Blocks send their distinct words with their own counts; the answer has the counts in the same order. ``n`` and ``v``
    add up to the words and the distinct words learned from.
    """
    width = np.uint64(-(-(1 << 64) // buckets) if buckets > 1 else 0)

    def ask(batches: pd.DataFrame) -> pd.DataFrame:
        h, owner = words(*text_buffer(batches["text"]))
        known, inverse = np.unique(h, return_inverse=True)
        count = np.bincount(inverse, weights=batches["learn"].to_numpy()[owner], minlength=len(known)).astype("<u4")
        bucket = (known // width).astype(np.int64) if buckets > 1 else np.zeros(len(known), np.int64)
        cut = np.searchsorted(bucket, np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(cut))
        return pd.DataFrame({"bucket": full.astype(np.int32), "block": np.full(len(full), batches["block"].iloc[0] if len(batches) else 0, np.int64),
                             "words": [known[cut[k]:cut[k + 1]].tobytes() for k in full], "counts": [count[cut[k]:cut[k + 1]].tobytes() for k in full]})

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(x, np.uint64) for x in rows["words"]]
        known, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        count = np.bincount(inverse, weights=np.concatenate([np.frombuffer(x, "<u4") for x in rows["counts"]]), minlength=len(known)).astype("<i8")
        ends = np.cumsum([len(p) for p in parts])
        n, v = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        n[0], v[0] = count.sum(), (count > 0).sum()
        return pd.DataFrame({"bucket": rows["bucket"], "block": rows["block"], "n": n, "v": v,
                             "counts": [count[inverse[b - len(p):b]].tobytes() for p, b in zip(parts, ends)]})

    asked = dealt.groupBy("block").applyInPandas(ask, "bucket int, block long, words binary, counts binary")
    return stored(asked.groupBy("bucket").applyInPandas(answer, "bucket int, block long, n long, v long, counts binary"), "word-counts")


def text_buffer(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    return utf8(pa.array(texts, pa.large_string()))


@functools.lru_cache(1)
def unpacked(packed: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The table and the gates; a worker process unpacks a model once."""
    return np.frombuffer(zlib.decompress(packed[0]), "<u4"), np.frombuffer(zlib.decompress(packed[1]), np.uint8)


def score(docs: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``; ``bits_per_byte`` besides.

    A null text counts as empty: one token, the end. A null id is learned from. Repeated rows count as often as they stand and score alike.
    With nothing to learn from, all counts are zero and each bit has probability one half. An empty table gives an
    empty table; other columns are not read. Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text_col).withColumn("learn", learnable(F.col("doc_id")))
    # every executor keeps the broadcast on its disk, so it is packed; each worker unpacks it once
    model = spark.sparkContext.broadcast(tuple(zlib.compress(part.tobytes(), 1) for part in learn(rows, params, F.col("learn"))))
    # texts of one class of length (bits of the number of bytes) share blocks, so that long ones advance side by side
    grade = F.length(F.bin(F.octet_length("text").cast("long")))
    sizes = rows.groupBy(grade.alias("grade")).agg(F.sum(F.octet_length("text") + F.lit(64)).alias("bytes"), F.sum(F.col("learn").cast("long")).alias("learned")).collect()
    share, ends = np.zeros(65, np.int64), sum(r["learned"] for r in sizes)
    for r in sizes:
        share[r["grade"]] = -(-r["bytes"] // params.block_bytes)
    blocks = max(1, int(share.sum()))
    head, many = (F.array(*[F.lit(x) for x in xs])[grade] for xs in ((np.cumsum(share) - share).tolist(), np.maximum(share, 1).tolist()))
    dealt = rows.withColumn("block", head + F.pmod(F.xxhash64("doc_id", "text"), many))
    answers = word_counts(dealt, max(1, blocks // 4))
    known = answers.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = (known["n"] or 0) + ends, (known["v"] or 0) + (ends > 0)

    def work(key: tuple, texts: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        if not len(texts):
            return pd.DataFrame({"doc_id": pd.array([], "Int64"), "held_out": [], "n_tokens": [], "n_known": [], "train_tokens": [], "base_score": [], "score": [], "bits_per_byte": []})
        data, offsets = text_buffer(texts["text"])
        m = len(texts)
        model_parts = unpacked(model.value)
        hashes, owners, base = [], [], 0
        whole = np.empty(len(data) + m * (PAD + 1), np.uint8)  # the framed texts, one span after the other
        word = np.empty(len(whole), np.uint32)
        begins, ends_at = np.empty(m, np.int64), np.empty(m, np.int64)
        for lo, hi in spans(offsets + 64 * np.arange(m + 1), BATCH):  # short texts weigh in too
            text, begin, end = framed(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
            so_far = word_hash(text)
            h, own = framed_words(text, begin, so_far)
            hashes.append(h)
            owners.append(own + lo)
            whole[base:base + len(text)], word[base:base + len(text)] = text, word_context(so_far)
            begins[lo:hi], ends_at[lo:hi] = begin + base, end + base
            base += len(text)
        del data, text, so_far
        found = score_framed(whole, begins, ends_at, word, *model_parts, params)
        del whole, word
        h, owner = np.concatenate(hashes), np.concatenate(owners)
        _, inverse = np.unique(h, return_inverse=True)
        counts = counts.sort_values("bucket")
        count = np.concatenate([np.frombuffer(x, "<i8") for x in counts["counts"]])[inverse] if len(counts) else np.zeros(0, np.int64)
        tokens = np.bincount(owner, minlength=m) + 1
        seen = np.bincount(owner, weights=count > 0, minlength=m).astype(np.int64) + (ends > 0)
        base = np.bincount(owner, weights=np.log10(count + 1.0), minlength=m) + np.log10(ends + 1.0) - tokens * np.log10(n + v + 1.0)
        return pd.DataFrame({"doc_id": texts["doc_id"].astype("Int64"), "held_out": ~texts["learn"], "n_tokens": tokens, "n_known": seen, "train_tokens": n,
                             "base_score": base, "score": found, "bits_per_byte": -found * np.log2(10.0) / (np.diff(offsets) + 1)})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(work, schema)
