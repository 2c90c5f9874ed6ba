"""MinHash near-duplicates by banded signatures.

A document's set is its distinct 2-word shingles (lower-cased A-Z, words are maximal runs of non-space bytes; a text
of one word is one shingle, a text without words has the empty set). Its minhashes are cut into ``bands`` bands of
``rows`` values; each band is a bucket, and sets that share a bucket are candidates. A pair of Jaccard similarity ``s``
meets in some bucket with probability ``1 - (1 - s**rows)**bands`` (0.9988 at 0.8 with the defaults).

Candidates are verified on the full sets, without expanding a bucket into all pairs: every member is compared with its
bucket's pivot (the member whose buckets are the largest); components of these links settle the buckets that lie in one
component. In the others, members of different components are compared with one another, except where their
distances to the pivot rule a link out: Jaccard distance is a metric, so two sets whose distances to a third differ
by more than ``1 - least`` lie further apart than that. In buckets with many such members those are compared that
share one of their rarest hashes (prefix filtering), which loses no link. No candidate pair that could join two components stays unverified.
Sets of fewer than ``least / (1 - least)`` elements can only equal another set, so they skip the buckets. Links
are ``100 * |A & B| >= 80 * |A | B|``; components are taken over verified links only. Exact copies of one set are
folded into their smallest id before any of this, so a group of thousands of copies is one set.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bizlens.llm.common import is_space, lower_ascii, spans, stored, utf8
from bizlens.llm.components import components

#: Bands and minhashes per band.
BANDS, ROWS = 17, 5
#: Unsettled members of a bucket that meet pair by pair; those of larger ones meet where they share a rare hash.
FEW = 16
#: Bytes of text whose sets are made at once (a longer text stands alone), and bytes whose words are hashed at once.
SPAN, STRETCH = 1 << 18, 1 << 16
#: Shingle hashes that one vectorised step holds (times the number of minhashes, in 8-byte words); a step fits a core's cache.
STEP = 1 << 9


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, wrapping modulo 2**64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(count: int) -> np.ndarray:
    return _mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def signatures(values: np.ndarray, offsets: np.ndarray, count: int) -> np.ndarray:
    """``count`` minhashes of each row's values (rows as ``offsets``); an empty row gets the largest value."""
    salt = seeds(count)
    out = np.full((len(offsets) - 1, count), np.iinfo(np.uint64).max, np.uint64)
    values = values.astype(np.uint64, copy=False)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    with np.errstate(over="ignore"):
        for lo in range(0, len(values), STEP):
            hashed = _mix(values[lo:lo + STEP, None] ^ salt[None, :])
            rows = row[lo:lo + STEP]
            starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            least = np.minimum.reduceat(hashed, starts, axis=0)
            out[rows[starts]] = np.minimum(out[rows[starts]], least)
    return out


#: A random 64-bit value per byte and an odd multiplier: words hash as polynomials of these, modulo 2**64.
BYTE_VALUES = None
RADIX = np.uint64(0x9E3779B97F4A7C15 | 1)


def _byte_values() -> np.ndarray:
    global BYTE_VALUES
    if BYTE_VALUES is None:
        BYTE_VALUES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return BYTE_VALUES


@functools.lru_cache(1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    """The powers 1, 2, ... of the multiplier, and 0, 1, ... of its inverse, as many as a stretch needs."""
    up, down = np.full(STRETCH, RADIX, np.uint64), np.full(STRETCH + 1, np.uint64(pow(int(RADIX), -1, 1 << 64)), np.uint64)
    down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_hashes(data: np.ndarray, ws: np.ndarray, we: np.ndarray) -> np.ndarray:
    """A hash of each word ``data[ws:we]``, made stretch by stretch; a word that runs on is the sum of its parts."""
    up, down = powers()
    word = np.zeros(len(ws), np.uint64)
    with np.errstate(over="ignore"):
        for lo in range(0, len(data), STRETCH):
            part = data[lo:lo + STRETCH]
            first, last = np.searchsorted(we, lo, "right"), np.searchsorted(ws, lo + len(part))
            if first == last:
                continue
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_byte_values()[part] * up[:len(part)], out=sums[1:])
            start = np.maximum(ws[first:last] - lo, 0)
            found = (sums[np.minimum(we[first:last] - lo, len(part))] - sums[start]) * down[start]
            if ws[first] < lo:
                found[0] *= np.uint64(pow(int(RADIX), int(lo - ws[first]), 1 << 64))
            word[first:last] += found
        return _mix(word + (we - ws).astype(np.uint64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of each row (bytes ``data`` cut at ``offsets``),
    and the offsets of each row's hashes. A-Z are lower-cased; words are maximal runs of bytes other than 0x20 and
    0x09-0x0D; a row of fewer words has its whole sequence as one shingle, a row without words none."""
    rows = len(offsets) - 1
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    low = lower_ascii(data)
    space = is_space(low)
    starts_row = np.zeros(len(data) + 1, bool)
    starts_row[offsets[:-1]] = True
    begin = ~space & (np.r_[True, space[:-1]] | starts_row[:-1])
    finish = ~space & (np.r_[space[1:], True] | starts_row[1:])
    ws, we = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    with np.errstate(over="ignore"):
        word = word_hashes(low, ws, we)
        row = np.searchsorted(offsets, ws, "right") - 1
        per_row = np.bincount(row, minlength=rows)
        first = np.r_[0, np.cumsum(per_row)][:-1]
        k = np.minimum(per_row, width)
        count = np.where(per_row >= width, per_row - width + 1, (per_row > 0).astype(np.int64))
        at = np.repeat(first, count) + (np.arange(count.sum()) - np.repeat(np.r_[0, np.cumsum(count)][:-1], count))
        span = np.repeat(k, count)
        h = np.zeros(len(at), np.uint64)
        for j in range(width):
            part = word[np.minimum(at + j, len(word) - 1)] if len(word) else h
            h = np.where(j < span, _mix(h * np.uint64(0xA24BAED4963EE407) + part), h)
        owner = np.repeat(np.arange(rows), count)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    keep = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])] if len(h) else np.zeros(0, bool)
    h, owner = h[keep], owner[keep]
    return h, np.r_[0, np.cumsum(np.bincount(owner, minlength=rows))].astype(np.int64)


def set_keys(h: np.ndarray, off: np.ndarray) -> pa.Array:
    """A 64-bit key of each set (hashes ``h`` cut at ``off``); null for an empty one."""
    sizes = np.diff(off)
    with np.errstate(over="ignore"):
        mixed = np.r_[np.uint64(0), np.cumsum(_mix(h ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)]
        keys = (mixed[off[1:]] - mixed[off[:-1]]) ^ (sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return pa.array(keys.view(np.int64), mask=sizes == 0)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per row and band of the minhashes ``sig``."""
    parts = sig.reshape(len(sig), bands, rows)
    keys = np.zeros((len(sig), bands), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(rows):
            keys = _mix(keys * np.uint64(0xA24BAED4963EE407) + parts[:, :, j])
    return keys


def worked(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The rows of ``batch`` (``doc_id``, ``text`` and any others) in spans of about ``SPAN`` bytes, with their sets."""
    data, offsets = utf8(pc.fill_null(batch.column(1), ""))
    for lo, hi in spans(offsets, SPAN):
        yield batch.slice(lo, hi - lo), *shingle_sets(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], width)


def profiles(batches: Iterator[pa.RecordBatch], width: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """``doc_id``, ``n`` (distinct shingles), ``set_key`` (null for an empty set) and ``keys`` (one per band)."""
    for batch in batches:
        for part, h, off in worked(batch, width):
            found = band_keys(signatures(h, off, bands * rows), bands, rows).view(np.int64)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, bands, dtype=np.int32)), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(off)), set_keys(h, off), keys], names=["doc_id", "n", "set_key", "keys"])


def full_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """``rep`` (the set's key), ``n`` and the sorted ``hashes`` of the rows ``doc_id``, ``text``, ``set_key`` whose text has this key's set."""
    for batch in batches:
        for part, h, off in worked(batch, width):
            lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(h.view(np.int64)))
            out = pa.RecordBatch.from_arrays([part.column(2), pa.array(np.diff(off)), lists], names=["rep", "n", "hashes"])
            yield out.filter(pc.fill_null(pc.equal(set_keys(h, off), part.column(2)), False))


def judged(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """``rep, pivot`` with their sizes ``n1, n2``, the Jaccard ``distance`` of their full sets, and ``ok`` where the similarity is at least ``least``
    (as a percentage test on whole numbers)."""
    left = sets.select("rep", F.col("hashes").alias("h1"), F.col("n").alias("n1"))
    right = sets.select(F.col("rep").alias("pivot"), F.col("hashes").alias("h2"), F.col("n").alias("n2"))
    inter = F.size(F.array_intersect("h1", "h2")).cast("long")
    found = pairs.join(left, "rep").join(right, "pivot").select("rep", "pivot", "n1", "n2", inter.alias("inter"))
    union = F.col("n1") + F.col("n2") - F.col("inter")
    return found.select("rep", "pivot", "n1", "n2", (F.lit(1.0) - F.col("inter") / union).alias("distance"),
                        (F.lit(100) * F.col("inter") >= F.lit(int(round(least * 100))) * union).alias("ok"))


def sharing_rare(wide: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs ``rep > pivot`` of the sets ``wide`` (``rep``, ``root``, ``n``) with different roots that may be similar: all that are, and few others.

    Hashes are ranked from the rarest. Sets of sizes ``n`` and ``m`` that link share ``o = least / (1 + least) * (n + m)`` hashes at least, so they
    share one among the first ``n - o + 1`` and ``m - o + 1``. Of each hash's list the commonest root meets only the others, not itself."""
    tokens = stored(wide.join(sets.select("rep", "hashes"), "rep").select("rep", "root", "n", F.explode("hashes").alias("token")), "minhash-tokens")
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("_f"))
    rank = F.row_number().over(Window.partitionBy("rep").orderBy("_f", "token"))
    first = tokens.join(often, "token").withColumn("rank", rank).filter(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * F.lit(least) - F.lit(1e-9)) + 1)
    first = stored(first.filter("_f > 1").drop("_f"), "minhash-rare")
    roots = first.groupBy("token", "root").agg(F.count(F.lit(1)).alias("_f"))
    main = roots.groupBy("token").agg(F.max_by("root", "_f").alias("main"), F.count(F.lit(1)).alias("_r")).filter("_r > 1").drop("_r")
    mixed = stored(first.join(main, "token"), "minhash-mixed")
    x, y = mixed.filter("root <> main").alias("x"), mixed.alias("y")
    share = F.ceil(F.lit(least / (1.0 + least)) * (F.col("x.n") + F.col("y.n")) - F.lit(1e-9))
    may = (F.col("x.token") == F.col("y.token")) & (F.col("x.root") != F.col("y.root")) & ((F.col("y.root") == F.col("y.main")) | (F.col("x.rep") > F.col("y.rep")))
    may &= (F.col("x.rank") <= F.col("x.n") - share + 1) & (F.col("y.rank") <= F.col("y.n") - share + 1)
    may &= F.least("x.n", "y.n") >= F.lit(least - 1e-9) * F.greatest("x.n", "y.n")
    return x.join(y, may).select(F.greatest("x.rep", "y.rep").alias("rep"), F.least("x.rep", "y.rep").alias("pivot")).distinct()


def verified_links(sets: DataFrame, members: DataFrame, least: float, few: int = FEW) -> DataFrame:
    """Links ``a``, ``b`` with the components of all links between sets that share a bucket (``rep`` and the bucket's columns in ``members``).

    Every member is compared with its bucket's pivot, the member whose buckets are the largest. Where the links found leave a bucket in several
    components, its members of different components are compared too: in buckets of up to ``few`` all but those that sizes or distances to
    the pivot rule out, in larger ones those that share a rare hash, which every link does.
    ``sets`` holds ``rep``, ``n`` and ``hashes`` of every set in ``members``."""
    bucket = [c for c in members.columns if c != "rep"]
    sized = members.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_m")).filter("_m > 1")
    weight = members.join(sized, bucket).groupBy("rep").agg(F.sum("_m").alias("_w"))
    pivots = members.join(weight, "rep").groupBy(*bucket).agg(F.max(F.struct("_w", "rep"))["rep"].alias("pivot"))
    placed = stored(members.join(pivots, bucket).filter("rep <> pivot"), "minhash-placed")
    stars = stored(judged(placed.select("rep", "pivot").distinct(), sets, least), "minhash-stars")
    linked = stored(components(stars.filter("ok").select(F.col("rep").alias("a"), F.col("pivot").alias("b"))), "minhash-linked")
    # buckets of three or more: two members other than the pivot, of different components
    rooted = placed.join(linked.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    split = rooted.groupBy(*bucket).agg(F.min("root").alias("_lo"), F.max("root").alias("_hi"), F.count(F.lit(1)).alias("members")).filter("_lo < _hi")
    near = stars.select("rep", "pivot", F.col("n1").alias("n"), "distance")
    rest = rooted.join(split.select(*bucket, "members"), bucket).join(near, ["rep", "pivot"])
    rest = stored(rest.select(*bucket, "rep", "root", "n", "distance", "members"), "minhash-rest")
    x, y = rest.filter(F.col("members") <= few).alias("x"), rest.filter(F.col("members") <= few).alias("y")
    may = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in bucket] + [
        F.col("x.rep") > F.col("y.rep"), F.col("x.root") != F.col("y.root"),
        F.abs(F.col("x.distance") - F.col("y.distance")) <= F.lit(1.0 - least + 1e-9),
        F.least("x.n", "y.n") >= F.lit(least - 1e-9) * F.greatest("x.n", "y.n")]
    pairs = x.join(y, may).select(F.col("x.rep").alias("rep"), F.col("y.rep").alias("pivot"))
    wide = rest.filter(F.col("members") > few).select("rep", "root", "n").distinct()
    seen = stars.select(F.greatest("rep", "pivot").alias("rep"), F.least("rep", "pivot").alias("pivot"))
    pairs = stored(pairs.union(sharing_rare(wide, sets, least)).distinct().join(seen, ["rep", "pivot"], "left_anti"), "minhash-pairs")
    late = judged(pairs, sets, least).filter("ok")
    return linked.select(F.col("node").alias("a"), F.col("root").alias("b")).union(late.select(F.col("rep").alias("a"), F.col("pivot").alias("b")))


def near_duplicates(docs: DataFrame, width: int = 2, least: float = 0.8, bands: int = BANDS, rows: int = ROWS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``n_shingles`` (set size), ``component_id`` (smallest id it reaches,
    itself included) and ``kept`` (``doc_id = component_id``).

    A null text counts as empty; an empty set links with nothing (its component is its own id). Repeated rows of one
    id and text share their set and component, and are all kept if that id is the component's. A row with a null id
    links with nothing and gets a null component and ``kept`` false. Columns other than the id and the text are not
    read, so extra columns cannot clash; an empty table gives an empty table. Shingles are compared by their 64-bit
    XXH64 hashes: two distinct shingles of one pair of documents that share a hash (odds near ``n**2 / 2**64``)
    would count as one.
    """
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    prof = stored(text.mapInArrow(lambda it: profiles(it, width, bands, rows), "doc_id long, n long, set_key long, keys array<long>"), "minhash-profiles")
    live = prof.filter("doc_id is not null and n > 0")
    reps = stored(live.groupBy("set_key", "n").agg(F.min("doc_id").alias("rep"), F.min_by("keys", "doc_id").alias("keys")), "minhash-reps")
    # Distinct sets A, B with |A & B| >= least * |A | B| >= least * (|A & B| + 1) share least / (1 - least) elements
    # at least: smaller sets link only with equal sets, which are folded already.
    smallest = int(np.ceil(least / (1.0 - least) - 1e-9)) if least < 1 else None
    every = reps.filter(F.col("n") >= F.lit(smallest)) if smallest is not None else reps.limit(0)
    every = every.select(F.col("set_key").alias("rep"), F.posexplode("keys").alias("band", "key")).select("rep", F.xxhash64("band", "key").alias("bucket"))
    crowded = every.groupBy("bucket").count().filter("count > 1").drop("count")
    members = stored(every.join(crowded, "bucket", "left_semi"), "minhash-members")
    met = members.select(F.col("rep").alias("set_key")).distinct()
    involved = reps.join(met, "set_key", "left_semi").select(F.col("rep").alias("doc_id"), "set_key")
    # the ids are hashed and the texts stream past them: a sort would hold whole texts
    again = text.join(involved.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "set_key")
    sets = again.mapInArrow(lambda it: full_sets(it, width), "rep long, n long, hashes array<long>")
    if not live.groupBy("doc_id").count().filter("count > 1").isEmpty():  # repeated rows of one id and set: any one of them
        sets = sets.dropDuplicates(["rep", "n"])
    sets = stored(sets, "minhash-sets")
    linked = components(verified_links(sets, members, least))
    roots = reps.select("set_key", "n", "rep").join(linked.select(F.col("node").alias("set_key"), "root"), "set_key", "left")
    roots = roots.withColumn("root", F.coalesce("root", "set_key"))
    first = roots.groupBy("root").agg(F.min("rep").alias("component_id"))
    roots = roots.join(first, "root").select("set_key", "n", "component_id")
    keyed = prof.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key"))
    out = keyed.join(roots, ["set_key", "n"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
