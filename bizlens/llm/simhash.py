"""SimHash near-duplicates by a generalised pigeonhole search.

The 64 bits are dealt into partitions so that correlated bits share one. If two fingerprints differ in at most ``distance``
bits and the partition thresholds (plus one each) add up to ``distance + 1``, some partition differs in no more
bits than its threshold. Thresholds are unequal: dynamic programming picks those with the least estimated
work, from the number of signatures to probe and of candidates that meet. Candidates are verified on all 64 bits.
"""

from __future__ import annotations

import dataclasses
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlens.llm.common import stored
from bizlens.llm.components import components

SEED = 42
BITS = 64
#: Fingerprints that the plan is estimated on; it decides the work, never the result.
PLAN_SAMPLE = 16_384
#: Postings of one signature that meet in one block; a larger signature is dealt into blocks, and blocks meet pair by pair.
BLOCK = 4096
#: Relative cost of sending a posting and of comparing two.
POSTING, COMPARISON = 100.0, 1.0


def fingerprint(text: bytes, width: int) -> int:
    """Votes of the hashes of all word shingles; a text of fewer words is one shingle, one without words has none."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # both for ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.append(0, ends[:-1] + 1)
    k = min(width, len(words))
    hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist())], ">u8")
    votes = np.zeros(BITS, np.int64)
    for lo in range(0, len(hashes), 8192):
        votes += np.unpackbits(hashes[lo:lo + 8192].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes)).tobytes(), "big")


def fingerprint_column(text: Column, width: int) -> Column:
    """The fingerprint as a signed 64-bit number."""

    @F.arrow_udf("long")
    def work(texts: pa.Array) -> pa.Array:
        found = np.array([fingerprint(t.as_py().encode("utf-8", "replace"), width) for t in texts], np.uint64)
        return pa.array(found.view(np.int64))

    return work(F.coalesce(text, F.lit("")))


@dataclasses.dataclass(frozen=True)
class Part:
    bits: tuple[int, ...]
    threshold: int

    @property
    def mask(self) -> int:
        return signed(sum(1 << b for b in self.bits))

    def flips(self) -> list[int]:
        """All changes of at most ``threshold`` of the bits, none first."""
        return [signed(sum(1 << b for b in c)) for k in range(self.threshold + 1) for c in itertools.combinations(self.bits, k)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def deal_bits(sample: np.ndarray, parts: int) -> list[tuple[int, ...]]:
    """Bits into ``parts`` sets of nearly equal size, each grown from a seed by its most correlated free bit."""
    if not len(sample):
        return [tuple(range(k, BITS, parts)) for k in range(parts)]
    on = (sample[:, None] >> np.arange(BITS, dtype=np.uint64) & np.uint64(1)).astype(np.float64)
    on -= on.mean(0)
    spread = np.sqrt((on * on).mean(0))
    tied = np.abs(on.T @ on / max(len(on), 1) / np.maximum(np.outer(spread, spread), 1e-12))
    free, dealt = set(range(BITS)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        own = [max(sorted(free), key=lambda b: tied[b, sorted(free - {b})].sum() if len(free) > 1 else 0.0)]
        free.discard(own[0])
        while len(own) < size:
            own.append(max(sorted(free), key=lambda b: tied[b, own].sum()))
            free.discard(own[-1])
        dealt.append(tuple(sorted(own)))
    return dealt


def estimated(sample: np.ndarray, bits: tuple[int, ...], threshold: int, total: int) -> float:
    """Work of one partition at one threshold over ``total`` fingerprints, carried over from the sample."""
    part = Part(bits, threshold)
    flips = np.array(part.flips(), np.int64).view(np.uint64)
    values, counts = np.unique(sample & np.uint64(part.mask & (1 << 64) - 1), return_counts=True)
    met = 0.0
    for flip in flips:
        other = values ^ flip
        at = np.minimum(np.searchsorted(values, other), len(values) - 1)
        met += float((counts * counts[at] * (values[at] == other)).sum())
    n = max(len(sample), 1)
    grown = max(met - (n if threshold >= 0 else 0), 0) * (total / n) ** 2 + total * total * len(flips) / 2.0 ** len(bits)
    return POSTING * total * len(flips) + COMPARISON * grown


def plan(sample: np.ndarray, total: int, distance: int) -> list[Part]:
    """The cheapest partitions and thresholds; a partition with threshold -1 is not probed."""
    best: tuple[float, list[Part]] | None = None
    few = sample[:4096]
    for parts in range(2, distance + 2):
        sets = deal_bits(sample, parts)
        budget = distance - parts + 1
        # cost[k][s]: least work for the first k partitions with s = sum of (threshold + 1)
        cost: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for bits in sets:
            step: dict[int, tuple[float, tuple[int, ...]]] = {}
            for t in range(-1, min(budget, 2) + 1 if parts > 1 else budget + 1):
                own = 0.0 if t < 0 else estimated(few, bits, t, total)
                for s, (c, chosen) in cost.items():
                    if s + t + 1 <= distance + 1 and (s + t + 1 not in step or c + own < step[s + t + 1][0]):
                        step[s + t + 1] = (c + own, (*chosen, t))
            cost = step
        if distance + 1 in cost and (best is None or cost[distance + 1][0] < best[0]):
            c, chosen = cost[distance + 1]
            best = (c, [Part(b, t) for b, t in zip(sets, chosen) if t >= 0])
    if best is None:
        return [Part(tuple(range(BITS)), distance)]
    return best[1]


def links(prints: DataFrame, distance: int, block: int = BLOCK) -> DataFrame:
    """A spanning forest per task of the links between distinct fingerprints ``fp``: ``a``, ``b``."""
    total = prints.count()
    picked = prints.orderBy(F.xxhash64("fp"), "fp").limit(PLAN_SAMPLE).collect()
    parts = plan(np.array([r["fp"] for r in picked], np.int64).view(np.uint64), total, distance)
    postings = None
    for k, part in enumerate(parts):
        flips = F.explode(F.array(*[F.lit(f).cast("long") for f in part.flips()]))
        own = prints.select("fp", flips.alias("flip")).select(
            F.lit(k).alias("part"), (F.col("fp").bitwiseAND(F.lit(part.mask))).bitwiseXOR(F.col("flip")).alias("sig"), "fp", (F.col("flip") != 0).alias("probe"))
        postings = own if postings is None else postings.unionAll(own)
    sizes = postings.groupBy("part", "sig").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block)
    hot = stored(sizes.select("part", "sig", F.ceil(F.col("n") / block).cast("int").alias("c")), "hot-signatures")
    whole = (F.lit(0).alias("i"), F.lit(0).alias("j"))
    if hot.isEmpty():
        dealt = postings.select("*", *whole)
    else:
        # every two blocks of a hot signature meet under their own key
        marked = postings.join(hot, ["part", "sig"], "left").withColumn("own", F.pmod(F.xxhash64("fp"), F.coalesce("c", F.lit(1))).cast("int"))
        pair = F.transform(F.sequence(F.lit(0), F.coalesce("c", F.lit(1)) - 1), lambda x: F.struct(F.least(x, "own").alias("i"), F.greatest(x, "own").alias("j")))
        dealt = marked.select("part", "sig", "fp", "probe", F.explode(pair).alias("p")).select("part", "sig", "fp", "probe", "p.i", "p.j")
    key = ["part", "sig", "i", "j"]
    ordered = dealt.repartition(*key).sortWithinPartitions(*key, "probe", "fp").select(*key, "probe", "fp")
    return ordered.mapInArrow(lambda batches: forest(batches, distance), "a long, b long")


def forest(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Verified links of runs with one key; a run cut by a batch's end waits for the next."""
    rest: list[np.ndarray] | None = None

    def cols(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [c.cast(pa.int64()).to_numpy(zero_copy_only=False) for c in batch.columns]

    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            if not batch.num_rows:
                continue
            now = cols(batch)
            now = [np.concatenate(x) for x in zip(rest, now)] if rest is not None else now
        elif rest is None:
            return
        else:
            now = rest
        change = np.flatnonzero(np.any([np.diff(c) != 0 for c in now[:4]], axis=0)) + 1
        end = len(now[0]) if batch is None else int(change[-1]) if len(change) else 0
        rest = [c[end:] for c in now]
        if end:
            run = np.zeros(end, np.int64)
            run[change[change < end]] = 1
            yield from found(np.cumsum(run), now[4][:end] != 0, now[5][:end], distance)


def found(run: np.ndarray, probe: np.ndarray, fp: np.ndarray, distance: int) -> Iterator[pa.RecordBatch]:
    """Links within runs, less those between rows that are already connected."""
    prints, node = np.unique(fp.view(np.uint64), return_inverse=True)
    root = np.arange(len(prints))
    out: list[tuple[int, int]] = []

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    at, step = np.arange(len(fp)), 1
    while len(at):
        at = at[at + step < len(fp)]
        at = at[run[at] == run[at + step]]
        a, b = node[at], node[at + step]
        use = ~probe[at] & (root[a] != root[b])
        a, b = a[use], b[use]
        near = np.bitwise_count(prints[a] ^ prints[b]) <= distance
        for x, y in zip(a[near].tolist(), b[near].tolist()):
            x, y = top(x), top(y)
            if x != y:
                out.append((x, y))
                root[max(x, y)] = min(x, y)
        if len(a) and near.any():
            while not np.array_equal(flat := root[root], root):
                root[:] = flat
        step += 1
    if out:
        pairs = prints.view(np.int64)[np.array(out)]
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def near_duplicates(docs: DataFrame, width: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text",
                    block: int = BLOCK, carry: tuple[Column, ...] = ()) -> DataFrame:
    """One row per input row: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``, ``root`` (a
    number of the component, also where its ids are null), and the ``carry`` columns.

    Fingerprints link at ``distance`` or fewer differing bits; a component holds all that such links reach. A null text
    counts as empty; texts without words have fingerprint zero and link like others. Repeated rows share a
    component. A null id takes no part in the minimum (a component of null ids only has a null id). An empty table gives an
    empty table; columns other than the id, the text and ``carry`` are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *carry)
    extra = [c for c in rows.columns if c not in ("doc_id", "text")]
    prints = stored(rows.select("doc_id", *extra, fingerprint_column(F.col("text"), width).alias("fp")), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    linked = components(links(distinct.select("fp"), distance, block))
    roots = distinct.join(linked.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = roots.select("fp", "root").join(least, "root").select("fp", "component_id", "root")
    return prints.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root", *extra)
