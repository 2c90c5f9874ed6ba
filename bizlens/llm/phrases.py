"""Phrase collocation mining over weighted acyclic automata of n-gram counts.

A text is lower-cased (A-Z only), cut at ``. , ; : ! ?`` and 0x0A-0x0D into pieces, and pieces into words (maximal
runs of bytes other than space and tab). Everything is per ``lang`` (null: ``und``). ``f(phrase)`` counts the
phrase's contiguous occurrences within pieces, overlaps included; ``n`` counts all word occurrences.

Texts are split into words twice: once to count the words, and once to write every shard (texts of one language, about
``STEP_BYTES``) as the 64-bit codes of its frequent words and the sequence of their numbers, zero where a piece ends or a
rare word stands. Phrases are counted on these sequences, one length at a time: pairs of frequent words, then phrases
whose both parts one word shorter are frequent, since a phrase is never more frequent than any part of it. A first pass over
a length only counts buckets of hashes (three bytes for each in a group of shards), a second one the phrases in buckets that
reach the threshold: most phrases are rare, and are never sent. In it a group of
shards turns its sequences into a sorted list of weighted n-grams: the language of a small acyclic automaton whose paths
are phrases (as codes) and whose weights are counts; the lists are united and their weights summed by a partitioning of
the phrases (by hash, not by prefix range: ``repartitionByRange`` samples its input first, which counted every shard twice).

What is frequent, and which buckets are, is sent to the tasks as bitmaps of bounded size. A rare phrase that passes them is
counted and then falls below the threshold, so counts are exact. Codes tell words apart exactly: all words that pass the bitmap of the
frequent ones are compared, and if two had one code, another seed is taken.
Composition with the count automaton (joins on language and phrase) gives, for each candidate and each cut, the
counts ``l`` and ``r`` of both parts; the score is ``floor(1000 * a * n / (l * r))`` in 38-digit decimals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bizlens.llm.common import STEP_BYTES, arrow_rows, stored, utf8

#: Fixed values of the contract: piece separators, word separators, the language of a null ``lang``, words of a phrase.
SEPARATORS = np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8)
SPACES = np.frombuffer(b" \t", np.uint8)
UNKNOWN = "und"
LONGEST = 5
#: Most bytes of the bitmap of what is frequent, which is sent to every task. Beyond it more rare phrases pass and are
#: counted (the same result, more rows).
BROADCAST_BYTES = 64 << 20
WORDS = "lang string, phrase string, f long"
CODED = "code long, lang string, phrase string, f long"
SHARDS = "words binary, places binary"
#: Rows of a task's word counts held before they are merged, and sent on when still more than half this after the merge;
#: word occurrences of the shards whose phrases are counted together.
FLUSH_ROWS = 1 << 21
#: Rows of the batches that tasks send on; entries of the batches of packed rows.
SEND_ROWS, PACKED_ROWS = 1 << 17, 1 << 24
#: Parts into which phrases are dealt by their hash; a power of two.
PARTS = 1 << 10
#: A longer word gets its code from ``hashlib`` instead of eight bytes at a time.
LONG_WORD = 512
#: Of every byte: 0 in a word, 1 between words, 2 between pieces; and the byte in lower case.
KIND = np.zeros(256, np.uint8)
KIND[SPACES], KIND[SEPARATORS] = 1, 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The first k bytes of a little-endian number.
FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def cut_long(texts: list[bytes], step: int) -> list[bytes]:
    """A text longer than ``step`` bytes, cut just after piece separators, so that no piece is split."""
    out = []
    for t in texts:
        while len(t) > step:
            data = np.frombuffer(t, np.uint8)
            at = np.flatnonzero(np.isin(data[:step], SEPARATORS))
            if len(at) == 0:
                later = np.flatnonzero(np.isin(data[step:], SEPARATORS))
                if len(later) == 0:
                    break
                cut = step + int(later[0]) + 1
            else:
                cut = int(at[-1]) + 1
            out.append(t[:cut])
            t = t[cut:]
        out.append(t)
    return out


def words_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of the texts, and of every word occurrence the number of its word and of its piece."""
    blob = b"\n".join(texts)
    try:
        blob.decode()
    except UnicodeDecodeError:
        blob = b"\n".join(t.decode("utf-8", "replace").encode() for t in texts)
    data = np.frombuffer(blob, np.uint8)
    kind = KIND[data]
    inside = kind == 0
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    first, last = edges[::2], edges[1::2]
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(last - first)])
    flat = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(LOWER[data[inside]]))
    coded = flat.dictionary_encode()
    return coded.dictionary, np.asarray(coded.indices, np.int64), np.cumsum(kind == 2, dtype=np.int64)[first]


def shards(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[tuple[str, pa.Array, np.ndarray, np.ndarray]]:
    """Language and ``words_of`` of texts of one language, about ``step`` bytes at a time."""
    for batch in batches:
        lang = pc.fill_null(batch.column("lang"), UNKNOWN).dictionary_encode()
        names, which = lang.dictionary.to_pylist(), np.asarray(lang.indices)
        data, offsets = utf8(pc.fill_null(batch.column("text"), ""))
        order = np.argsort(which, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(which[order])) + 1):
            held, size = [], 0
            for i in rows:
                for t in cut_long([data[offsets[i]:offsets[i + 1]].tobytes()], step):
                    if held and size + len(t) > step:
                        yield names[which[i]], *words_of(held)
                        held, size = [], 0
                    held.append(t)
                    size += len(t)
            if held:
                yield names[which[rows[0]]], *words_of(held)


def _merged(tables: list[pa.Table]) -> pa.Table:
    both = pa.concat_tables(tables).group_by(["lang", "phrase"]).aggregate([("f", "sum")])
    return pa.table({"lang": both["lang"], "phrase": both["phrase"], "f": both["f_sum"]})


def counted_words(batches: Iterator[pa.RecordBatch], step: int, flush: int) -> Iterator[pa.RecordBatch]:
    """The word counts of a task, built shard by shard: every shard's counts are merged into them; when they are more than
    ``flush`` rows after a merge, they are sent on and begun anew."""
    held: list[pa.Table] = []
    rows = 0
    for lang, words, at, _ in shards(batches, step):
        if len(words) == 0:
            continue
        held.append(pa.table({"lang": pa.repeat(lang, len(words)), "phrase": words.cast(pa.string()), "f": np.bincount(at, minlength=len(words))}))
        rows += len(words)
        if rows > flush:
            held = [_merged(held)]
            rows = len(held[0])
            if rows > flush // 2:
                yield from held[0].to_batches(SEND_ROWS)
                held, rows = [], 0
    if held:
        yield from _merged(held).to_batches(SEND_ROWS)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one map of 64-bit numbers that spreads them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seed_of(lang: str, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")


def codes_of(words: pa.Array, seeds: np.ndarray) -> np.ndarray:
    """The 64-bit code of every word, given the seed of its language."""
    data, offsets = utf8(words)
    length, at = np.diff(offsets), offsets[:-1]
    lanes = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    codes = mixed(seeds + length.astype(np.uint64))
    left = np.flatnonzero(length > 0)
    for k in range(0, LONG_WORD, 8):
        if len(left) == 0:
            break
        more = length[left] - k
        codes[left] = mixed(codes[left] ^ (lanes[at[left] + k] & FIRST_BYTES[np.minimum(more, 8)]))
        left = left[more > 8]
    for i in left:
        rest = hashlib.blake2b(data[at[i] + LONG_WORD:at[i] + length[i]].tobytes(), digest_size=8, key=codes[i].tobytes())
        codes[i] = int.from_bytes(rest.digest(), "little")
    return codes


def joint(codes: list[np.ndarray]) -> np.ndarray:
    """A hash of each phrase, given the codes of its first, second, ... words; of a single word, its code."""
    return reduce(lambda h, c: mixed(h * np.uint64(0x9E3779B97F4A7C15) + c), codes)


def bits_of(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each hash in a bitmap of ``size`` bits, a power of two of at most 2^32."""
    low = np.uint64(size - 1)
    return hashes & low, (hashes >> np.uint64(32)) & low


def passes(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be one of those the bitmap was made of."""
    one, two = bits_of(hashes, 8 * len(bitmap))
    seven = np.uint64(7)
    return ((bitmap[one >> np.uint64(3)] >> (one & seven).astype(np.uint8)) & (bitmap[two >> np.uint64(3)] >> (two & seven).astype(np.uint8)) & 1).view(bool)


def dealt(hashes: DataFrame, size: int) -> np.ndarray:
    """The bitmap of ``size`` bits whose set places stand, as packed numbers, in the rows of ``at``."""
    bitmap = np.zeros(size >> 3, np.uint8)
    for r in hashes.collect():
        at = np.frombuffer(r.at, "<u4")
        np.bitwise_or.at(bitmap, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
    return bitmap


def size_for(bits: int) -> int:
    """At least ``bits``, as a power of two, within the bounds of a bitmap."""
    return max(1 << 16, min(1 << max(bits - 1, 0).bit_length(), 8 << (BROADCAST_BYTES.bit_length() - 1)))


def places(batches: Iterator[pa.RecordBatch], columns: list[str], size: int) -> Iterator[pa.RecordBatch]:
    """The places of a batch's phrases in a bitmap of ``size`` bits, as one row."""
    for batch in batches:
        found = bits_of(joint([np.asarray(batch.column(c)).view(np.uint64) for c in columns]), size)
        yield arrow_rows(["at"], [pa.array([np.unique(np.concatenate(found)).astype("<u4").tobytes()], pa.binary())])


def bitmap_of(rows: DataFrame, columns: list[str]):
    """A broadcast bitmap of the phrases in ``rows``, whose words' codes are in ``columns``; None if there are no rows."""
    n = rows.count()
    if n == 0:
        return None
    size = size_for(16 * n)
    found = rows.select(*columns).mapInArrow(lambda it: places(it, columns, size), "at binary")
    return rows.sparkSession.sparkContext.broadcast(dealt(found, size))


def coded(batches: Iterator[pa.RecordBatch], seed: int, frequent) -> Iterator[pa.RecordBatch]:
    """Words with their codes; with a bitmap, those that pass it."""
    for batch in batches:
        lang = batch.column("lang").dictionary_encode()
        seeds = np.array([seed_of(x, seed) for x in lang.dictionary.to_pylist()], np.uint64)
        codes = codes_of(batch.column("phrase"), seeds[np.asarray(lang.indices)])
        out = arrow_rows(["code", "lang", "phrase", "f"], [codes.view(np.int64), batch.column("lang"), batch.column("phrase"), batch.column("f")])
        yield out if frequent is None else out.filter(pa.array(passes(frequent.value, codes)))


def word_codes(one: DataFrame, least: int):
    """The words counted at least ``least`` times with their codes, the bitmap of the codes (None: no such words) and their
    seed, under which no other word of ``one`` that passes the bitmap has the code of a frequent one or of another."""
    seed = 0
    while True:
        frequent = stored(one.filter(F.col("f") >= least).mapInArrow(lambda it, s=seed: coded(it, s, None), CODED), "phrase-codes")
        bitmap = bitmap_of(frequent, ["code"])
        if bitmap is None:
            return frequent, None, seed
        near = one.mapInArrow(lambda it, s=seed, b=bitmap: coded(it, s, b), CODED)
        if near.groupBy("code").count().filter("count > 1").isEmpty():
            return frequent, bitmap, seed
        bitmap.unpersist()
        seed += 1


def sequences(batches: Iterator[pa.RecordBatch], step: int, seed: int, frequent) -> Iterator[pa.RecordBatch]:
    """Every shard as the codes of its words that may be frequent, and its sequence of numbers into these (from 1, in two bytes
    if they fit), zero between pieces and for other words. A word without such a neighbour in its piece is left out."""
    for lang, words, at, piece in shards(batches, step):
        codes = codes_of(words, np.full(len(words), seed_of(lang, seed), np.uint64))
        good = passes(frequent.value, codes)[at]
        near = good[1:] & good[:-1] & (piece[1:] == piece[:-1])
        follows = np.concatenate([[False], near])
        kept = np.flatnonzero(follows | np.concatenate([near, [False]])) if len(at) else at
        if len(kept) == 0:
            continue
        used, number = np.unique(at[kept], return_inverse=True)
        out = np.zeros(len(kept) + int((~follows[kept]).sum()), np.uint16 if len(used) < 1 << 16 else np.uint32)
        out[np.arange(len(kept)) + np.cumsum(~follows[kept])] = number + 1
        yield arrow_rows(["words", "places"], [pa.array([codes[used].astype("<u8").tobytes()], pa.binary()), pa.array([out.tobytes()], pa.binary())])


def summed(columns: list[np.ndarray], base: int, weights: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of columns of numbers below ``base``, sorted, and the sum of each row's weights (None: 1 each)."""
    key, most, ranked = columns[0], base, {}
    for j in range(1, len(columns)):
        if most > (1 << 62) // base:
            ranked[j], key = np.unique(key, return_inverse=True)
            most = len(ranked[j])
        key, most = key * base + columns[j], most * base
    if weights is None:
        key, count = np.unique(key, return_counts=True)
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[:len(key)])
        key, count = key[first], np.add.reduceat(weights[order], first) if len(first) else weights
    out = []
    for j in range(len(columns) - 1, 0, -1):
        key, last = np.divmod(key, base)
        out.append(last)
        if j in ranked:
            key = ranked[j][key]
    return [key, *out[::-1]], count


def grams(group: list[tuple[np.ndarray, np.ndarray]], size: int, frequent: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The codes of the words in the shards of a group, the sequence of their numbers (from 1), and where in it a phrase of
    ``size`` words begins whose both parts one word shorter pass; ``frequent`` has the bitmaps of phrases of 2, 3, ... words."""
    words, number = np.unique(np.concatenate([w for w, _ in group]), return_inverse=True)
    row, lo = [], 0
    for w, s in group:
        row.append(np.concatenate([[0], number[lo:lo + len(w)] + 1])[s])
        lo += len(w)
    row = np.concatenate(row)
    ok = row != 0
    for k in range(2, size + 1):
        ok = ok[:-1] & ok[1:]
        if k < size:
            at = np.flatnonzero(ok)
            ok[at] = passes(frequent[k - 2], joint([words[row[at + j] - 1] for j in range(k)]))
    return words, row, np.flatnonzero(ok)


def groups(batches: Iterator[pa.RecordBatch], flush: int) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """The shards of a task, taken together up to ``flush`` word occurrences."""
    group, held = [], 0
    for batch in batches:
        for i in range(len(batch)):
            words = np.frombuffer(batch.column("words")[i].as_buffer(), "<u8")
            row = np.frombuffer(batch.column("places")[i].as_buffer(), np.uint16 if len(words) < 1 << 16 else np.uint32)
            if group and held + len(row) > flush:
                yield group
                group, held = [], 0
            group.append((words, row))
            held += len(row)
    if group:
        yield group


def packed(part: np.ndarray, names: list[str], columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """One row for each of the sorted ``part`` numbers: its entries of each column as packed bytes."""
    for lo in range(0, len(part), PACKED_ROWS):
        own = part[lo:lo + PACKED_ROWS].astype(np.int32)
        edges = np.concatenate([np.flatnonzero(np.diff(own, prepend=-1)), [len(own)]])
        arrays = [pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * c.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(c[lo:lo + PACKED_ROWS]))]) for c in columns]
        yield arrow_rows(["part", *names], [own[edges[:-1]], *arrays])


def buckets_of(hashes: np.ndarray, size: int) -> np.ndarray:
    """The bucket of each hash among ``size``, a power of two; the first bits are its part."""
    return hashes >> np.uint64(65 - size.bit_length())


def sketched(batches: Iterator[pa.RecordBatch], size: int, frequent: list, buckets: int, least: int, flush: int) -> Iterator[pa.RecordBatch]:
    """How many phrases of ``size`` words each group of shards has in every bucket of their hashes; ``least`` stands for more."""
    known = [b.value for b in frequent]
    for group in groups(batches, flush):
        words, row, at = grams(group, size, known)
        bucket = buckets_of(joint([words[row[at + j] - 1] for j in range(size)]), buckets).astype(np.uint32)
        bucket, count = np.unique(bucket, return_counts=True)
        place = (bucket & np.uint32(buckets // PARTS - 1)).astype(np.min_scalar_type(buckets // PARTS - 1))
        yield from packed(bucket // np.uint32(buckets // PARTS), ["place", "n"], [place, np.minimum(count, least).astype(np.min_scalar_type(least))])


def crowded(batches: Iterator[pa.RecordBatch], buckets: int, least: int) -> Iterator[pa.RecordBatch]:
    """The buckets with ``least`` phrases or more, given the groups' counts sorted by part."""
    each = buckets // PARTS
    now, held = -1, np.zeros(each, np.int64)

    def sent():
        at = (np.flatnonzero(held >= least) + now * each).astype("<u4")
        return arrow_rows(["at"], [pa.array([at.tobytes()], pa.binary())])

    for batch in batches:
        for i, part in enumerate(batch.column("part").to_pylist()):
            if part != now:
                if now >= 0:
                    yield sent()
                now = part
                held[:] = 0
            held[np.frombuffer(batch.column("place")[i].as_buffer(), np.min_scalar_type(each - 1))] += np.frombuffer(batch.column("n")[i].as_buffer(), np.min_scalar_type(least))
    if now >= 0:
        yield sent()


def counted(batches: Iterator[pa.RecordBatch], size: int, frequent: list, likely, flush: int) -> Iterator[pa.RecordBatch]:
    """The weighted phrases of ``size`` words of each group of a task's shards that stand in the buckets of ``likely``."""
    known, names = [b.value for b in frequent], columns_of(size)
    for group in groups(batches, flush):
        words, row, at = grams(group, size, known)
        bucket = buckets_of(joint([words[row[at + j] - 1] for j in range(size)]), 8 * len(likely.value))
        at = at[((likely.value[bucket >> np.uint64(3)] >> (bucket & np.uint64(7)).astype(np.uint8)) & 1).view(bool)]
        numbers, count = summed([row[at + j] - 1 for j in range(size)], len(words))
        columns = [words[c] for c in numbers]
        part = buckets_of(joint(columns), PARTS)
        order = np.argsort(part, kind="stable")
        yield from packed(part[order], [*names, "n"], [*(c[order] for c in columns), count[order].astype(np.int64)])


def united(batches: Iterator[pa.RecordBatch], size: int, least: int, flush: int) -> Iterator[pa.RecordBatch]:
    """The phrases of all groups with their weights summed, of those that reach ``least``, given rows sorted by part."""
    names = [*columns_of(size), "n"]
    now, held, entries = -1, [], 0

    def merged():
        columns = [np.concatenate([h[k] for h in held]) for k in range(size + 1)]
        words, number = np.unique(np.concatenate(columns[:size]), return_inverse=True)
        numbers, count = summed(np.split(number, size), len(words), columns[size])
        return [*(words[c] for c in numbers), count]

    def sent():
        *columns, count = merged()
        good = count >= least
        return arrow_rows([*columns_of(size), "f"], [*(c[good].view(np.int64) for c in columns), count[good]])

    for batch in batches:
        for i, part in enumerate(batch.column("part").to_pylist()):
            if part != now:
                if held:
                    yield sent()
                now, held, entries = part, [], 0
            held.append([np.frombuffer(batch.column(c)[i].as_buffer(), np.int64 if c == "n" else np.uint64) for c in names])
            entries += len(held[-1][0])
            if entries > flush and len(held) > 1:
                held, entries = [merged()], 0
    if held:
        yield sent()


def columns_of(size: int) -> list[str]:
    return [f"w{k}" for k in range(1, size + 1)]


def level(rows: DataFrame, size: int, frequent: list, buckets: int, least: int) -> DataFrame:
    """Counts of the phrases of ``size`` words, of those counted ``least`` times or more. The shards are read twice: first only
    buckets of phrases are counted, then the phrases in the buckets that reach ``least``. Both are united and summed by a hash
    of the whole phrase, in packed parts."""
    flush, names = FLUSH_ROWS, columns_of(size)
    # Hash partitioning of the whole key: a range partitioning would first sample, and so count every shard twice.
    sketch = rows.mapInArrow(lambda it: sketched(it, size, frequent, buckets, least, flush), "part int, place binary, n binary")
    sketch = sketch.repartition("part").sortWithinPartitions("part").mapInArrow(lambda it: crowded(it, buckets, least), "at binary")
    likely = rows.sparkSession.sparkContext.broadcast(dealt(sketch, buckets))
    lists = rows.mapInArrow(lambda it: counted(it, size, frequent, likely, flush), ", ".join(["part int", *(f"{c} binary" for c in [*names, "n"])]))
    lists = lists.repartition("part").sortWithinPartitions("part")
    many = stored(lists.mapInArrow(lambda it: united(it, size, least, flush), ", ".join(f"{c} long" for c in [*names, "f"])), f"phrase-level{size}")
    likely.unpersist()
    return many


def spelled(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """``(lang, size, phrase, f)`` of phrases given as arrays ``ws`` of codes."""
    each = phrases.select("ws", "f", F.posexplode("ws").alias("i", "code")).join(words.select("code", "lang", F.col("phrase").alias("word")), "code")
    each = each.groupBy("ws", "f", "lang").agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias("x"))
    return each.select("lang", F.size("ws").alias("size"), F.array_join(F.col("x.word"), " ").alias("phrase"), "f")


def counts(docs: DataFrame, least: int = 100, step: int = STEP_BYTES) -> tuple[DataFrame, DataFrame]:
    """``(lang, size, phrase, f)`` of every phrase of 1 to 5 words with ``f >= least``, exact; and ``(lang, n)``."""
    flush = FLUSH_ROWS
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    one = rows.mapInArrow(lambda it: counted_words(it, step, flush), WORDS).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    one = stored(one, "phrase-words")
    total = stored(one.groupBy("lang").agg(F.sum("f").alias("n")), "phrase-totals")
    words, bitmap, seed = word_codes(one, least)
    found = words.select("lang", F.lit(1).alias("size"), "phrase", "f")
    if bitmap is not None:
        rows = stored(rows.mapInArrow(lambda it: sequences(it, step, seed, bitmap), SHARDS), "phrase-shards")
        buckets = size_for(16 * total.agg(F.sum("n")).first()[0] // max(least, 1))
        longer, frequent = [], []
        for size in range(2, LONGEST + 1):
            many = level(rows, size, frequent, buckets, least)
            longer.append(many.select(F.array(*columns_of(size)).alias("ws"), "f"))
            if size < LONGEST:
                frequent.append(bitmap_of(many, columns_of(size)))
                if frequent[-1] is None:
                    break
        found = stored(found.unionByName(spelled(reduce(DataFrame.union, longer), words)), "phrase-counts")
        for b in [bitmap, *frequent]:
            if b is not None:
                b.unpersist()
    return found, total


def mine(docs: DataFrame, least: int = 100, top: int = 2000, step: int = STEP_BYTES) -> DataFrame:
    """Each language's ``top`` collocations of 2 to 5 words: ``lang``, ``rank`` (from 1), ``phrase``, ``a`` (its count),
    ``l`` and ``r`` (counts of the parts at its lowest-scoring cut, ties to the smallest cut), ``n`` (words of the
    language), ``score`` = ``floor(1000 * a * n / (l * r))``; ordered by score and ``a`` descending, then phrase (bytes).

    Candidates have ``a >= least``; one whose words lie inside a longer candidate of the same count is dropped. Null
    text counts as empty, null ``lang`` as ``und``; repeated rows count as often as they occur. Only ``lang`` and
    ``text`` are read, so other columns cannot clash. An empty table, or one without candidates, gives no rows.
    """
    found, total = counts(docs, least, step)
    cand = found.filter("size >= 2").select("lang", "size", "phrase", F.col("f").alias("a"))
    longer = cand.filter("size >= 3").select("lang", F.col("a").alias("fa"), F.split("phrase", " ").alias("w"), "size")
    inner = longer.select(F.col("lang").alias("il"), "fa", F.explode(F.array(F.array_join(F.slice("w", 1, F.col("size") - 1), " "),
                                                                          F.array_join(F.slice("w", 2, F.col("size") - 1), " "))).alias("ip"))
    kept = cand.join(inner, (F.col("lang") == F.col("il")) & (F.col("phrase") == F.col("ip")) & (F.col("fa") >= F.col("a")), "left_anti")
    cuts = kept.select("lang", "size", "phrase", "a", F.split("phrase", " ").alias("w"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("left"),
                       F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("right"))
    parts = found.select("lang", "phrase", "f")
    left = parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    scored = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(total, "lang")
    big = "decimal(38,0)"
    score = F.expr(f"(CAST(1000 AS {big}) * CAST(a AS {big}) * CAST(n AS {big})) div (CAST(l AS {big}) * CAST(r AS {big}))")
    scored = scored.withColumn("score", score.cast("long"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    best = best.select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(64))
    near = best.withColumn("_s", salt).withColumn("_k", F.row_number().over(Window.partitionBy("lang", "_s").orderBy(*order)))
    near = near.filter(F.col("_k") <= top).drop("_s", "_k")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
