"""Removal of long byte strings that occur earlier in the corpus, by merging shard Burrows-Wheeler transforms.

1. Each window of ``window`` bytes is keyed by its minimizer (the k-gram of smallest hash in it): equal windows have equal
   keys wherever they stand. Neighbouring windows with one minimizer form a fragment (at most
   ``window - gram + 1`` of them).
2. Fragments of a key that are equal throughout are one string with several occurrences; all but the first are removed.
   A key with one distinct fragment is finished.
3. The distinct fragments of the other keys are dealt by key. A task cuts them into shards, sorts the suffixes of each shard
   for its Burrows-Wheeler transform, and merges the shards by interleave refinement: rows ordered by their first h symbols
   are stably sorted by the symbols before them, which orders the rows those lead to by h + STEP symbols. Blocks
   of rows from one shard are dropped, as that shard's own order decides them; what is left after ``window`` symbols are the
   strings repeated across shards. No suffix is compared again.
4. In each class of equal windows all but the earliest are removed.
5. Windows of a key with too many distinct fragments are sorted by 128 bits of hash instead, and all but the first of each are removed as they stream by.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bizlens.llm.common import stored, utf8

WINDOW, GRAM = 100, 32
SCAN_BYTES = 1 << 20
#: Symbols of a shard, and of all shards that one step of a task merges.
SHARD, GROUP = 1 << 18, 1 << 20
#: Symbols per refinement step.
STEP = 4
#: Fragments of one key that meet; a key with more is dealt by single windows, whose copies never meet.
HOT = 20_000
#: Documents looked at for keys that stand in this share of all documents with ever new surroundings.
SAMPLE, HOT_SHARE = 2000, 0.04

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))
MIX = np.uint64(0xD6E8FEB86659FD93)
NO_ID = (1 << 63) - 1


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * MIX
    return (h ^ h >> np.uint64(29)) * MIX


@functools.lru_cache(2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, np.uint64), np.full(n, UNBASE, np.uint64)
    up[:1] = down[:1] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    out, span = h, 1
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[:len(out) - (width - span)], out[width - span:]) if span < width else out


def fragments(data: np.ndarray, offsets: np.ndarray, window: int, gram: int, hot: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, start in the row, windows, key, content hash) of every fragment, a stretch of bytes at a time."""
    for lo in range(0, len(data) - window + 1, SCAN_BYTES):
        part = data[lo:lo + SCAN_BYTES + window - 1]
        n = len(part)
        row = np.searchsorted(offsets, np.arange(lo, lo + n), "right") - 1 if len(offsets) > 2 else np.zeros(n, np.int64)
        up, down = (x[:n] for x in powers(SCAN_BYTES + window))
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up, out=prefix[1:])
        grams = mix((prefix[gram:] - prefix[:-gram]) * down[:n - gram + 1])
        least = sliding_min(grams, window - gram + 1)
        whole = row[:len(least)] == row[window - 1:]
        new = np.ones(len(least), bool)
        new[1:] = (least[1:] != least[:-1]) | (row[1:len(least)] != row[:len(least) - 1])
        # past the minimizer's first place: equal windows so lie in different fragments, also in periodic text
        new[1:] |= grams[:len(least) - 1] == least[:-1]
        single = np.isin(least, hot) if len(hot) else np.zeros(len(least), bool)
        new |= single
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(least))
        # the last windows of a row reach into the next one and belong to no fragment
        inside = np.append(0, np.cumsum(whole))
        end = start + (inside[end] - inside[start])
        start, end = start[whole[start]], end[whole[start]]
        content = mix((prefix[end + window - 1] - prefix[start]) * down[start])
        key = np.where(single[start], mix(least[start] ^ content), least[start])
        yield row[start], lo + start - offsets[row[start]], end - start, key, content


def packed(sub: np.ndarray, start: np.ndarray, windows: np.ndarray, done: np.ndarray | int = 0) -> np.ndarray:
    """Place of a fragment as one number that orders like (text of the id, start); ``done`` marks a removed one."""
    return sub.astype(np.int64) << 41 | start.astype(np.int64) << 9 | np.int64(1) * done << 8 | windows.astype(np.int64)


def scan(batches: Iterator[pa.RecordBatch], window: int, gram: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Fragments of documents. Equal fragments of one batch are folded: all but the first are marked as removed."""
    for batch in batches:
        doc, sub = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        data, offsets = utf8(batch.column(2))
        for row, start, windows, key, content in fragments(data, offsets, window, gram, hot):
            place, owner = packed(sub[row], start, windows), doc[row]
            order = np.lexsort((place, owner, content, key))
            key, content, owner, place = key[order], content[order], owner[order], place[order]
            again = np.zeros(len(key), bool)
            again[1:] = (key[1:] == key[:-1]) & (content[1:] == content[:-1])
            twin = np.zeros(len(key), bool)  # a repeated row of the same document: the place is the same
            twin[1:] = again[1:] & (owner[1:] == owner[:-1]) & (place[1:] == place[:-1])
            key = np.where(again, mix(owner.astype(np.uint64) ^ place.astype(np.uint64)), key)
            place = np.where(again, place | 256, place)
            keep = ~twin
            yield pa.RecordBatch.from_arrays([pa.array(x[keep].view(np.int64)) for x in (key, content, owner, place)],
                                             names=["key", "content", "doc", "place"])


def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From fragments sorted by key, content and place: those removed (``open`` false), and the first of each content where its key
    has several contents (``open`` true). Only one row is carried from batch to batch."""
    last: tuple[int, ...] | None = None  # the row before
    held: tuple[int, ...] | None = None  # the first content of the current key, until another content is seen

    def out(rows: list[np.ndarray], is_open: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[2]), pa.array(rows[3]), pa.array(np.full(len(rows[0]), is_open))],
                                          names=["key", "doc", "place", "open"])

    for batch in batches:
        cols = [c.to_numpy() for c in batch.columns]
        done = (cols[3] & 256) != 0
        if done.any():
            yield out([c[done] for c in cols], False)
            cols = [c[~done] for c in cols]
        if not len(cols[0]):
            continue
        lead = last if last is not None else (None, None, None, None)
        same_key = np.append(last is not None and cols[0][0] == lead[0], cols[0][1:] == cols[0][:-1])
        same = same_key & np.append(last is not None and cols[1][0] == lead[1], cols[1][1:] == cols[1][:-1])
        twin = same & np.append(last is not None and (cols[2][0], cols[3][0]) == lead[2:], (cols[2][1:] == cols[2][:-1]) & (cols[3][1:] == cols[3][:-1]))
        gone = same & ~twin
        if gone.any():
            yield out([c[gone] for c in cols], False)
        last = tuple(c[-1] for c in cols)
        firsts = np.flatnonzero(~same)
        if not len(firsts):
            continue
        own = [c[firsts] for c in cols]
        joins = same_key[firsts]  # another content of this key came before
        if held is not None:
            own = [np.append(h, c) for h, c in zip(held, own)]
            joins = np.append(False, joins)
        several = joins | np.append(joins[1:], False)
        if held is None and joins[0]:
            several[0] = True
        held = None if several[-1] else tuple(c[-1] for c in own)
        if several.any():
            yield out([c[several] for c in own], True)


def single_windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Each window of the listed fragments of documents, as ``scan`` gives fragments."""
    for batch in batches:
        doc, sub = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for k in range(batch.num_rows):
            raw, parts = batch.column(2)[k].as_py().encode(), batch.column(3)[k].values
            at = np.concatenate([np.arange(a, a + n) for a, n in zip(parts.field(1).to_pylist(), parts.field(2).to_pylist())])
            digests = b"".join([hashlib.blake2b(raw[a:a + window], digest_size=16).digest() for a in at.tolist()])
            key, content = np.frombuffer(digests, "<i8").reshape(-1, 2).T.copy()
            place = packed(np.full(len(at), sub[k]), at, np.ones(len(at), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, content, np.full(len(at), doc[k]), place)], names=["key", "content", "doc", "place"])


def suffix_ranks(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Suffix array of a shard to at least ``depth`` symbols by prefix doubling, and the ranks by 4, 8, 16, ... symbols."""
    n = len(symbols)
    bits = np.uint64(max(n.bit_length(), 1))
    low = (np.uint64(1) << bits) - np.uint64(1)
    place = np.arange(n, dtype=np.uint64)
    padded = np.append(symbols, np.zeros(4, symbols.dtype)).astype(np.uint64)
    head = padded[:n] << np.uint64(27) | padded[1:n + 1] << np.uint64(18) | padded[2:n + 2] << np.uint64(9) | padded[3:n + 3]
    ranks, h = {}, 4
    while True:
        order = np.sort(head << bits | place)
        at, head = (order & low).astype(np.int64), order >> bits
        rank = np.empty(n, np.uint64)
        rank[at] = np.append(np.uint64(0), np.cumsum(head[1:] != head[:-1]).astype(np.uint64)) if n else head
        ranks[h] = rank
        if h >= depth:
            return at, ranks
        second = np.zeros(n, np.uint64)
        second[:max(n - h, 0)] = rank[h:] + np.uint64(1)
        head, h = rank * np.uint64(n + 1) + second, h * 2


def classes(texts: list[np.ndarray], window: int, shard: int = SHARD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of every window of the given strings: (string, offset, class); windows are equal where classes are."""
    lengths = np.array([len(t) for t in texts], np.int64)
    bounds, size = [0], 0
    for k, n in enumerate(lengths):
        if size and size + n + 1 > shard:
            bounds.append(k)
            size = 0
        size += n + 1
    bounds.append(len(texts))
    bwt, back, row_class, row_window, base, used = [], [], [], [], 0, 0
    where: list[tuple[np.ndarray, np.ndarray]] = []
    for lo, hi in zip(bounds, bounds[1:]):
        ends = np.cumsum(lengths[lo:hi] + 1)
        symbols = np.zeros(int(ends[-1]) if hi > lo else 0, np.uint16)
        starts = ends - lengths[lo:hi] - 1
        inner = np.repeat(starts - np.append(0, np.cumsum(lengths[lo:hi])[:-1]), lengths[lo:hi]) + np.arange(int(lengths[lo:hi].sum()))
        symbols[inner] = np.concatenate(texts[lo:hi]).astype(np.uint16) + 1
        n = len(symbols)
        at, ranks = suffix_ranks(symbols, window)
        half = max(h for h in ranks if h <= window)
        owner = np.repeat(np.arange(lo, hi), lengths[lo:hi] + 1)
        offset = np.arange(n) - np.repeat(starts, lengths[lo:hi] + 1)
        is_window = offset + window <= np.repeat(lengths[lo:hi], lengths[lo:hi] + 1)
        # equal first `window` symbols: equal ranks of the two stretches of `half` symbols that cover them
        far = np.minimum(np.arange(n) + window - half, n - 1)
        pair = ranks[half] * np.uint64(n + 1) + ranks[half][far]
        _, own = np.unique(pair[is_window], return_inverse=True)
        label = np.full(n, -1, np.int64)
        label[is_window] = own + used
        used += int(own.max()) + 1 if len(own) else 0
        row_of = np.empty(n, np.int64)
        row_of[at] = np.arange(n)
        before = at - STEP
        # the STEP symbols before a suffix; none where its string is shorter, as no window leads there
        code = np.zeros(n, np.uint64)
        for j in range(STEP):
            code = code << np.uint64(9) | symbols[np.maximum(before + j, 0)].astype(np.uint64)
        usable = (before >= 0) & (offset[at] >= STEP)
        bwt.append(np.where(usable, code, np.uint64(0)))
        back.append(np.where(usable, row_of[np.maximum(before, 0)] + base, -1))
        row_class.append(label[at])
        where.append((owner[is_window], offset[is_window]))
        row_window.append(own + used - (int(own.max()) + 1 if len(own) else 0))
        base += n
    strings, offsets = (np.concatenate(x) for x in zip(*where))
    found = np.concatenate(row_window)
    if len(bounds) > 2:
        joined = merge(bwt, back, np.concatenate(row_class), window)
        if joined is not None:
            found = joined(found, used)
    return strings, offsets, found


def merge(bwt: list[np.ndarray], back: list[np.ndarray], row_class: np.ndarray, window: int):
    """Interleave the shards' rows to ``window`` symbols; returns how to put the classes of equal windows together."""
    shard = np.repeat(np.arange(len(bwt)), [len(b) for b in bwt])
    _, code = np.unique(np.concatenate(bwt), return_inverse=True)
    code, lead = code.astype(np.uint64), np.concatenate(back)
    rows, block = np.arange(len(shard)), np.zeros(len(shard), np.uint64)
    wide = np.uint64(max(int(code.max()).bit_length(), 1))
    for _ in range(window // STEP):
        go = lead[rows] >= 0
        rows, block = rows[go], block[go]
        if not len(rows):
            return None
        low = np.uint64(len(rows).bit_length())
        key = block << wide | code[rows]
        if int(block.max()).bit_length() + int(wide) + int(low) <= 64:  # rows are in order, so their number breaks ties as a stable sort does
            order = np.sort(key << low | np.arange(len(rows), dtype=np.uint64))
            place, key = (order & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64), order >> low
        else:
            place = np.argsort(key, kind="stable")
            key = key[place]
        rows = lead[rows[place]]
        cut = np.append(True, key[1:] != key[:-1])
        block = np.cumsum(cut) - 1
        # a block stays while rows of several shards are in it
        starts = np.flatnonzero(cut)
        own = shard[rows]
        mixed = np.minimum.reduceat(own, starts) != np.maximum.reduceat(own, starts)
        stay = mixed[block]
        rows, block = rows[stay], np.cumsum(cut[stay] if stay.any() else cut[:0])
        block = block.astype(np.uint64)
        if not len(rows):
            return None
    label = row_class[rows]
    use = label >= 0
    label, block = label[use], block[use].astype(np.int64)

    def joined(found: np.ndarray, used: int) -> np.ndarray:
        name = np.arange(used)
        name[label] = used + block  # all rows of a class are in one block
        return name[found]

    return joined


def repeats(doc: np.ndarray, sub: np.ndarray, start: np.ndarray, texts: list[np.ndarray], window: int, shard: int = SHARD) -> tuple[np.ndarray, ...]:
    """(doc, sub, start, windows) of runs of windows that also start earlier, among the given fragments."""
    string, offset, label = classes(texts, window, shard)
    begin = start[string] + offset
    order = np.lexsort((begin, sub[string], doc[string], label))
    label, string, begin = label[order], string[order], begin[order]
    again = np.append(False, label[1:] == label[:-1])
    string, begin = string[again], begin[again]
    # the same window of the same document may lie in two fragments only if rows repeat; it never removes itself
    owner, part = doc[string], sub[string]
    order = np.lexsort((begin, part, owner))
    owner, part, begin = owner[order], part[order], begin[order]
    cut = np.append(True, (owner[1:] != owner[:-1]) | (part[1:] != part[:-1]) | (begin[1:] != begin[:-1] + 1))[:len(begin)]
    at = np.flatnonzero(cut)
    return owner[at], part[at], begin[at], np.diff(np.append(at, len(begin)))


def identified(docs: DataFrame, id_col: str, text_col: str, extra: tuple[str, ...] = ()) -> tuple[DataFrame, bool]:
    """``doc`` (the id, a null one last), ``sub`` (the text's number among different texts of one id), ``text``; whether ids repeat."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *extra)
    many = stored(rows.select("doc").groupBy("doc").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc"), "repeated-ids")
    if many.isEmpty():
        return rows.withColumn("sub", F.lit(0).cast("long")), False
    named = rows.withColumn("digest", F.sha2("text", 256))
    number = F.row_number().over(Window.partitionBy("doc").orderBy("digest")).cast("long") - 1
    subs = stored(named.select("doc", "digest").join(many, "doc", "left_semi").distinct().withColumn("sub", number), "texts-of-repeated-ids")
    out = named.join(subs, ["doc", "digest"], "left").withColumn("sub", F.coalesce("sub", F.lit(0).cast("long")))
    return out.drop("digest"), True


def hot_keys(rows: DataFrame, window: int, gram: int) -> np.ndarray:
    """Keys with a different fragment in at least HOT_SHARE of about SAMPLE documents, picked by a hash of their id (fewer than 1 / HOT_SHARE times the keys of a
    document). Their windows are keyed one by one, which spreads them; it changes no result."""
    every = max(1, rows.count() // SAMPLE)
    sample = rows.select("doc", "sub", "text").filter(F.pmod(F.xxhash64("doc", "sub"), F.lit(every)) == 0)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scan(batches, window, gram, np.zeros(0, np.uint64)):
            yield batch

    found = sample.mapInArrow(work, "key long, content long, doc long, place long").filter(F.col("place").bitwiseAND(F.lit(256)) == 0)
    count = found.select("key", "content").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    least = max(16, int(SAMPLE * HOT_SHARE))
    return np.sort(np.array([r["key"] for r in count.filter(F.col("n") >= least).select("key").collect()], np.int64).view(np.uint64))


def removals(rows: DataFrame, window: int, gram: int, hot: int = HOT) -> DataFrame:
    """``doc, sub, start, windows``: runs of windows that also start earlier."""
    common = hot_keys(rows, window, gram)
    found = rows.select("doc", "sub", "text").mapInArrow(lambda b: scan(b, window, gram, common), "key long, content long, doc long, place long")
    dealt = found.repartition("key").sortWithinPartitions("key", "content", "doc", "place")
    sifted = stored(dealt.mapInArrow(sift, "key long, doc long, place long, open boolean"), "fragments")

    def placed(rows: DataFrame) -> DataFrame:
        return rows.select("*", F.shiftright("place", 41).alias("sub"), F.shiftright("place", 9).bitwiseAND(F.lit((1 << 32) - 1)).alias("start"),
                           F.col("place").bitwiseAND(F.lit(255)).alias("windows"))

    spread = placed(sifted)
    rest = spread.filter("open")
    crowded = stored(rest.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("key"), "crowded-keys")
    split = not crowded.isEmpty()

    def texts_of(part: DataFrame) -> DataFrame:
        wanted = part.groupBy("doc", "sub").agg(F.collect_list(F.struct("key", "start", "windows")).alias("parts"))
        return rows.select("doc", "sub", "text").join(wanted, ["doc", "sub"]).select("doc", "sub", "text", "parts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, sub = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for k in range(batch.num_rows):
                raw, out = batch.column(2)[k].as_py().encode(), []
                parts = batch.column(3)[k].values
                for key, start, windows in zip(*(parts.field(j).to_pylist() for j in range(3))):
                    out.append((key, start, raw[start:start + windows + window - 1]))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array(np.full(len(out), doc[k])), pa.array(np.full(len(out), sub[k])),
                                                  pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())],
                                                 names=["key", "doc", "sub", "start", "bytes"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, doc, sub, start, texts in whole_keys(batches):
            runs = repeats(doc, sub, start, texts, window)
            if len(runs[0]):
                yield pa.RecordBatch.from_arrays([pa.array(r) for r in runs], names=["doc", "sub", "start", "windows"])

    pieces = texts_of(rest.join(crowded, "key", "left_anti") if split else rest).mapInArrow(cut, "key long, doc long, sub long, start long, bytes binary")
    matched = pieces.repartition("key").sortWithinPartitions("key", "doc", "sub", "start").mapInArrow(match, "doc long, sub long, start long, windows long")
    gone = spread.filter("not open")
    if split:
        singles = texts_of(rest.join(crowded, "key", "left_semi")).mapInArrow(lambda b: single_windows(b, window), "key long, content long, doc long, place long")
        folded = singles.repartition("key").sortWithinPartitions("key", "content", "doc", "place").mapInArrow(sift, "key long, doc long, place long, open boolean")
        gone = gone.unionByName(placed(folded.filter("not open")))  # the first of each window, and windows that share a key only, are open
    return gone.select("doc", "sub", "start", "windows").unionByName(matched)


def whole_keys(batches: Iterator[pa.RecordBatch], group: int = GROUP) -> Iterator[tuple]:
    """Fragments sorted by key, in groups of whole keys of about ``group`` bytes. A key with one text is passed over, and a
    repeated row of one document is dropped; of equal texts of one key only the first two places are needed apart."""
    held: list[tuple] = []
    size = 0

    def pack(rows: list[tuple]) -> Iterator[tuple]:
        if rows:
            yield (np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), np.array([r[3] for r in rows]),
                   [np.frombuffer(r[4], np.uint8) for r in rows])

    run: list[tuple] = []

    def close() -> Iterator[tuple]:
        """The key's rows join the group; one that does not fit begins the next group."""
        nonlocal held, size
        own = sum(len(r[4]) for r in run)
        if len(run) > 1:
            if held and size + own > group:
                yield from pack(held)
                held, size = [], 0
            held.extend(run)
            size += own
        run.clear()

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if run and row[0] != run[0][0]:
                yield from close()
            if run and row[1:4] == run[-1][1:4]:
                continue
            run.append(row)
    yield from close()
    yield from pack(held)


def spans_of(start: np.ndarray, windows: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed runs [a, b) of overlapping or touching removals."""
    order = np.argsort(start, kind="stable")
    a, b = start[order], np.maximum.accumulate((start + windows)[order] + window - 1)
    if not len(a):
        return a, b
    new = np.append(True, a[1:] > b[:-1])
    return a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)]


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text",
                   with_text: bool = False, carry: tuple[str, ...] = (), hot: int = HOT) -> DataFrame:
    """Per row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``; ``with_text`` adds ``kept``, and ``carry`` other columns.

    Every byte covered by a ``window``-byte string that also starts earlier (smaller id, or same document and earlier) is
    removed; strings are judged on the input. A null text counts as empty; texts shorter than ``window`` lose nothing. A null
    id comes after all others. Different texts of one id count in the order of their SHA-256; of equal rows of one id one counts
    as the first. In ``kept`` what is left of a character cut by a removal is dropped. An empty table gives an empty
    table; columns other than the id, the text and ``carry`` are not read.
    """
    rows, repeated = identified(docs, id_col, text_col, carry)
    runs = stored(removals(rows, window, gram, hot), "removals")
    listed = runs.groupBy("doc", "sub").agg(F.collect_list("start").alias("starts"), F.collect_list("windows").alias("windows"))
    joined = rows.join(listed, ["doc", "sub"], "left")
    if repeated:
        copy = F.row_number().over(Window.partitionBy("doc", "sub").orderBy("doc")) > 1
        joined = joined.withColumn("copy", copy)
    else:
        joined = joined.withColumn("copy", F.lit(False))

    @F.arrow_udf("struct<n_bytes:long,n_removed:long,n_spans:long,kept_sha256:string" + (",kept:string" if with_text else "") + ">")
    def apply(texts: pa.Array, starts: pa.Array, windows: pa.Array, copies: pa.Array) -> pa.Array:
        out: list[tuple] = []
        for k in range(len(texts)):
            raw = texts[k].as_py().encode()
            if copies[k].as_py() and len(raw) >= window:
                a, b = np.array([0]), np.array([len(raw)])
            elif starts[k].is_valid:
                a, b = spans_of(starts[k].values.to_numpy(), windows[k].values.to_numpy(), window)
            else:
                a = b = np.zeros(0, np.int64)
            edges = [0, *np.stack([a, b], 1).ravel().tolist(), len(raw)]
            kept = b"".join([raw[x:y] for x, y in zip(edges[::2], edges[1::2])]) if len(a) else raw
            row = (len(raw), len(raw) - len(kept), len(a), hashlib.sha256(kept).hexdigest())
            out.append((*row, kept.decode("utf-8", "ignore")) if with_text else row)
        names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
        kinds = [pa.int64()] * 3 + [pa.string()] * (2 if with_text else 1)
        return pa.StructArray.from_arrays([pa.array([r[j] for r in out], kinds[j]) for j in range(len(names))], names=names)

    done = joined.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), *carry, apply("text", "starts", "windows", "copy").alias("r"))
    return done.select("doc_id", "r.*", *carry)
