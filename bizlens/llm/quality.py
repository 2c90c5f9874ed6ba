"""Quality classifier on supervised subword embeddings.

A document is the mean of learned vectors of its hashed words and character n-grams; a softmax over its product with
the output weights gives the classes. Vectors and weights are trained together by stochastic gradient descent on a
bounded sample of labelled documents. For scoring, each bucket's vector is multiplied by the output weights
beforehand: the mean of these products is the product of the mean.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlens.llm.common import bounded_sample, is_space, keyed, spans, stored, utf8


@dataclasses.dataclass(frozen=True)
class Params:
    """``sample`` bounds the labelled rows of each class that the model is fitted on; all else is the model's shape."""

    sample: int = 2500
    buckets_log2: int = 18
    dim: int = 16
    grams: tuple[int, ...] = (3, 4, 5)
    epochs: int = 4
    rate: float = 1.0
    seed: int = 7
    accept: float = 0.7


BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))
MIX = np.uint64(0xD6E8FEB86659FD93)
REPEAT = 0


def buckets(data: np.ndarray, offsets: np.ndarray, params: Params) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word and n-gram, and the document each belongs to.

    A word that repeats the one before it, and its n-grams, all go to one bucket of their own, so that repetition
    is learned as such. Each text is framed by spaces; an n-gram may hold a space only at its ends, so it lies in one word or at its edge.
    Hashes are differences of one prefix sum of byte values times powers of an odd base.
    """
    n_docs = len(offsets) - 1
    framed = np.full(len(data) + n_docs + 1, 32, np.uint8)
    doc_of = np.repeat(np.arange(n_docs, dtype=np.int32), np.diff(offsets))
    framed[np.arange(len(data)) + doc_of + 1] = data
    n = len(framed)
    owner = np.repeat(np.arange(n_docs, dtype=np.int32), np.diff(offsets) + 1)
    owner = np.append(owner, np.int32(max(n_docs - 1, 0)))
    power = np.full(n, BASE, np.uint64)
    back = np.full(n, UNBASE, np.uint64)
    power[:1], back[:1] = 1, 1
    power, back = np.multiply.accumulate(power), np.multiply.accumulate(back)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((framed.astype(np.uint64) + np.uint64(1)) * power, out=prefix[1:])
    space = is_space(framed)
    blanks = np.zeros(n + 1, np.int32)
    np.cumsum(space, out=blanks[1:])
    shift = np.uint64(64 - params.buckets_log2)

    def bucket(start: np.ndarray, end: np.ndarray, salt: int) -> np.ndarray:
        h = (prefix[end] - prefix[start]) * back[start] + np.uint64(salt)
        h ^= h >> np.uint64(32)
        h *= MIX
        h ^= h >> np.uint64(29)
        return ((h * MIX) >> shift).astype(np.int32)

    edge = np.diff(space.astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
    words, owners = bucket(starts, ends, 1), [owner[starts - 1]]
    again = np.zeros(len(starts), bool)
    again[1:] = (words[1:] == words[:-1]) & (np.diff(ends - starts) == 0) & (np.diff(owners[0]) == 0)
    turn = np.zeros(n + 1, np.int8)
    turn[starts[again] - 1] += 1
    turn[ends[again] - 1] -= 1
    repeated = np.cumsum(turn, dtype=np.int8)[:n] > 0
    words[again] = REPEAT
    found = [words]
    for k in params.grams:
        if n < k:
            continue
        # bytes 1..k-2 of the window hold no space, and not all of a window is one
        at = np.flatnonzero((blanks[k - 1:n] == blanks[1:n - k + 2]))
        found.append(np.where(repeated[at], REPEAT, bucket(at, at + k, k)))
        owners.append(owner[at])
    return np.concatenate(found), np.concatenate(owners)


def fit_arrays(texts: list[str], wanted: np.ndarray, params: Params) -> bytes:
    """Folded model: a float32 logit per bucket, then the bias; classes are 0 and 1."""
    size = 1 << params.buckets_log2
    n1, n = int(wanted.sum()), len(wanted)
    if n1 in (0, n):
        bias = np.log((n1 + 1) / (n - n1 + 1))
        return np.append(np.zeros(size), bias).astype("<f4").tobytes()
    rng = np.random.default_rng(params.seed)
    docs = []
    for text in texts:
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        ids, _ = buckets(raw, np.array([0, len(raw)]), params)
        ids, counts = np.unique(ids, return_counts=True)
        docs.append((ids, (counts / max(counts.sum(), 1)).astype(np.float32)))
    vectors = ((rng.random((size, params.dim), np.float32) - 0.5) / params.dim).astype(np.float32)
    weights, bias = np.zeros((2, params.dim), np.float32), np.zeros(2, np.float32)
    total, step = params.epochs * n, 0
    for _ in range(params.epochs):
        for k in rng.permutation(n):
            ids, share = docs[k]
            rate = np.float32(params.rate * (1 - step / total))
            step += 1
            known = vectors[ids]
            hidden = share @ known
            logits = weights @ hidden + bias
            p = np.exp(logits - logits.max())
            error = p / p.sum()
            error[int(wanted[k])] -= 1
            pull = error @ weights
            weights -= rate * error[:, None] * hidden[None, :]
            bias -= np.float32(0.02) * rate * error
            vectors[ids] = known - (rate * share)[:, None] * pull[None, :]
    folded = vectors @ (weights[1] - weights[0])
    return np.append(folded, bias[1] - bias[0]).astype("<f4").tobytes()


def learnable(id_col: Column) -> Column:
    """Rows whose labels may be learned from."""
    return F.crc32(id_col.cast("string").cast("binary")) % 4 != 2


def fit(docs: DataFrame, labels: DataFrame, params: Params = Params(), label_col: str = "quality", id_col: str = "doc_id",
        text_col: str = "text") -> bytes:
    """Train on at most ``params.sample`` labelled rows of each class, picked by a hash of their id.

    Null ids, null labels and labels other than 0 and 1 are not learned from. The sample is joined
    by its ids, so only its texts move; training runs in one task, as the sample is bounded.
    """
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    marked = marked.filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & learnable(F.col("doc_id")))
    total = marked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()
    picked = stored(bounded_sample(marked, "y", "doc_id", params.sample), "labelled")
    sample = keyed(docs, id_col, text_col).join(picked, "doc_id").repartition(1)
    prior = {r["y"]: r["n"] for r in total}

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches) or [pd.DataFrame({"doc_id": [], "text": [], "y": []})])
        rows = rows.sort_values(["doc_id", "y", "text"])
        model = np.frombuffer(fit_arrays(rows["text"].tolist(), rows["y"].to_numpy(np.int64), params), "<f4").copy()
        used = np.bincount(rows["y"].to_numpy(np.int64), minlength=2)
        if used.min() and len(prior) == 2:  # the sample's share of each class is not the table's
            model[-1] += np.log(prior[1] / prior[0]) - np.log(used[1] / used[0])
        yield pd.DataFrame({"model": [model.tobytes()]})

    found = sample.mapInPandas(train, "model binary").collect()
    return bytes(found[0]["model"]) if found else fit_arrays([], np.zeros(0, np.int64), params)


def scores(texts: pa.Array, model: np.ndarray, params: Params) -> np.ndarray:
    """Probability of class 1 of each whole text; a text without words gets that of the bias."""
    data, offsets = utf8(texts)
    out = np.empty(len(offsets) - 1)
    for lo, hi in spans(offsets):
        ids, owner = buckets(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], params)
        count = np.bincount(owner, minlength=hi - lo)
        total = np.bincount(owner, weights=model[ids], minlength=hi - lo)
        out[lo:hi] = total / np.maximum(count, 1) + model[-1]
    return 1 / (1 + np.exp(-np.clip(out, -700, 700)))


def score_column(model: bytes, text: Column, params: Params = Params()) -> Column:
    """The score as a column of any frame; nothing but the text goes to Python."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(scores(texts, np.frombuffer(model, "<f4"), params))

    return score(F.coalesce(text, F.lit("")))


def classify(docs: DataFrame, model: bytes, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``held_out``, ``score``, ``predicted`` (1 where the score is at least ``params.accept``).

    A null text counts as empty. Repeated rows get equal scores; a null id is not held out. An empty table gives an empty table.
    """
    rows = keyed(docs, id_col, text_col)
    out = rows.select("doc_id", F.coalesce(~learnable(F.col("doc_id")), F.lit(False)).alias("held_out"), score_column(model, F.col("text"), params).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= params.accept).cast("int"))
