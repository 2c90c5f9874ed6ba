"""Language identification with a string kernel.

The kernel of two texts is the number of byte n-grams of length 1 to ``longest`` present in both (each once), divided
by the root of the product of their own numbers, over the n-grams that the landmarks hold. A Nyström map on the
landmarks makes it finite; one-versus-rest ridge regression on the mapped sample gives a weight per landmark and language.
Texts are scored in batches: presence matrix times landmark matrix times weights.
"""

from __future__ import annotations

import dataclasses
import functools
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlens.llm.common import bounded_sample, keyed, lower_ascii, spans, stored, utf8


@dataclasses.dataclass(frozen=True)
class Params:
    """``sample`` and ``landmarks`` bound the rows of each language that the model is fitted on."""

    sample: int = 300
    landmarks: int = 24
    longest: int = 3
    ridge: float = 1e-2


NO_LANGUAGE = "und"
SPAN_BYTES, SPAN_ROWS = 1 << 19, 192


def codes(data: np.ndarray, n: int) -> np.ndarray:
    """Each n-gram as one number, its length in the top byte."""
    out = data[:max(len(data) - n + 1, 0)].astype(np.uint32)
    for k in range(1, n):
        out = out << np.uint32(8) | data[k:len(data) - n + 1 + k]
    return out


def distinct(raw: np.ndarray, longest: int) -> list[np.ndarray]:
    """The sorted distinct n-grams of one text, per length."""
    return [np.unique(codes(raw, n)) for n in range(1, longest + 1)]


class Vocabulary:
    """n-gram to column number, one direct table per length."""

    def __init__(self, grams: list[np.ndarray]):
        self.size, self.tables = 0, []
        for n, own in enumerate(grams, 1):
            lookup = np.full(1 << (8 * n), -1, np.int32)
            lookup[own] = np.arange(len(own), dtype=np.int32) + self.size
            self.tables.append(lookup)
            self.size += len(own)

    def presence(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Documents times n-grams, 1 where present; no n-gram reaches over the end of its text."""
        n_docs = len(offsets) - 1
        out = np.zeros(n_docs * self.size, np.float32)
        owner = np.repeat(np.arange(n_docs, dtype=np.int64) * self.size, np.diff(offsets))
        for n, lookup in enumerate(self.tables, 1):
            if len(data) < n:
                break
            at = lookup[codes(data, n)]
            first = owner[:len(at)]
            hit = (at >= 0) & (first == owner[n - 1:])
            out[at[hit] + first[hit]] = 1
        return out.reshape(n_docs, self.size)


def unit_rows(present: np.ndarray) -> np.ndarray:
    return present / np.sqrt(np.maximum(present.sum(1, keepdims=True), 1))


def fit_arrays(texts: list[str], langs: list[str], params: Params) -> bytes:
    """The model: languages, the landmarks' n-grams, the landmark matrix and the weights."""
    names = sorted(set(langs))
    raws = [lower_ascii(np.frombuffer(t.encode("utf-8", "replace"), np.uint8)) for t in texts]
    chosen, seen = [], {name: 0 for name in names}
    for k, lang in enumerate(langs):
        if seen[lang] < params.landmarks and len(raws[k]):
            seen[lang] += 1
            chosen.append(k)
    found = [distinct(raws[k], params.longest) for k in chosen]
    grams = [np.unique(np.concatenate([f[n] for f in found])) if found else np.zeros(0, np.uint32) for n in range(params.longest)]
    vocabulary = Vocabulary(grams)

    def rows(of: list[int]) -> np.ndarray:
        return unit_rows(np.vstack([vocabulary.presence(raws[k], np.array([0, len(raws[k])])) for k in of]))

    if not chosen:
        return pickle.dumps((names, grams, np.zeros((0, 0), np.float32), np.zeros((0, len(names)), np.float32)))
    marks = rows(chosen)
    own = (marks @ marks.T).astype(np.float64)
    values, basis = np.linalg.eigh(own)
    keep = values > 1e-6 * values.max()
    root = basis[:, keep] / np.sqrt(values[keep])
    mapped = np.vstack([rows(list(range(lo, min(lo + 64, len(raws))))) @ marks.T for lo in range(0, len(raws), 64)]).astype(np.float64) @ root
    wanted = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    # each language weighs the same, whatever its share of the sample
    weight = 1 / np.array([langs.count(x) for x in names])[np.searchsorted(names, langs)] / len(names)
    gram = mapped.T @ (mapped * weight[:, None])
    ridge = np.linalg.solve(gram + params.ridge / len(raws) * np.eye(gram.shape[0]), mapped.T @ (wanted * weight[:, None]))
    return pickle.dumps((names, grams, marks.T.astype(np.float32).copy(), (root @ ridge).astype(np.float32)))


@functools.lru_cache(2)
def _model(packed: bytes) -> tuple[list[str], Vocabulary, np.ndarray, np.ndarray]:
    names, grams, marks, weights = pickle.loads(packed)
    return names, Vocabulary(grams), marks, weights


def predict(texts: pa.Array, packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Number of the best language of each whole text (ties: the first in order) and its score in 0..1."""
    _, vocabulary, marks, weights = _model(packed)
    data, offsets = utf8(texts)
    data = lower_ascii(data)
    best, score = np.zeros(len(offsets) - 1, np.int64), np.zeros(len(offsets) - 1)
    for lo, hi in spans(offsets, SPAN_BYTES):
        for a in range(lo, hi, SPAN_ROWS):
            b = min(a + SPAN_ROWS, hi)
            present = vocabulary.presence(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
            norm = np.sqrt(np.maximum(present.sum(1), 1))
            found = (present @ marks @ weights) / norm[:, None]
            best[a:b] = found.argmax(1)
            score[a:b] = np.clip((found.max(1) + 1) / 2, 0, 1)
    return best, score


def learnable(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 5 != 0


def fit(docs: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> bytes:
    """Train on at most ``params.sample`` rows of each language, picked by a hash of their id.

    Rows without id or language, and texts without a letter, are not learned from. The sample is joined by its ids, so only its texts move.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).alias("lang"))
    fit_for = rows.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & learnable(F.col("doc_id")))
    picked = stored(bounded_sample(fit_for, "lang", "doc_id", params.sample), "languages")
    sample = keyed(docs, id_col, text_col).join(picked, "doc_id").filter(F.col("text").rlike(r"\p{L}")).repartition(1)

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches) or [pd.DataFrame({"lang": [], "text": [], "doc_id": []})]).sort_values(["doc_id", "lang", "text"])
        yield pd.DataFrame({"model": [fit_arrays(rows["text"].tolist(), rows["lang"].tolist(), params)]})

    found = sample.mapInPandas(train, "model binary").collect()
    return bytes(found[0]["model"]) if found else fit_arrays([], [], params)


def identify(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``held_out``, ``lang_pred``, ``score``.

    ``und`` and 0 where the text is null, empty or has no letter, and for every text if no language was learned. Repeated
    rows get equal results; a null id is not held out. An empty table gives an empty table. Of equal scores the first
    language in alphabetical order wins.
    """
    names = _model(model)[0]

    @F.arrow_udf("struct<best:int,score:double>")
    def scored(texts: pa.Array) -> pa.Array:
        best, score = predict(texts, model)
        return pa.StructArray.from_arrays([pa.array(best.astype(np.int32)), pa.array(score)], names=["best", "score"])

    rows = keyed(docs, id_col, text_col)
    held = F.coalesce(~learnable(F.col("doc_id")), F.lit(False)).alias("held_out")
    if not names:
        return rows.select("doc_id", held, F.lit(NO_LANGUAGE).alias("lang_pred"), F.lit(0.0).alias("score"))
    some = F.col("text").rlike(r"\p{L}")
    out = rows.select("doc_id", held, some.alias("some"), scored("text").alias("s"))
    pick = F.element_at(F.array(*[F.lit(x) for x in names]), F.col("s.best") + 1)
    return out.select("doc_id", "held_out", F.when(F.col("some"), pick).otherwise(NO_LANGUAGE).alias("lang_pred"),
                      F.when(F.col("some"), F.col("s.score")).otherwise(0.0).alias("score"))
