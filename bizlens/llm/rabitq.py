"""Nearest neighbours by inner product on randomly rotated one-bit codes.

Every vector is rotated by one random orthogonal matrix and kept as the signs of its coordinates (packed bits), its norm,
and the product of its direction with its sign vector. These give an unbiased estimate of the inner product
with a query and a bound on its error. Vectors whose upper bound reaches the k-th best lower bound are reranked on the
original components in double precision.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bizlens.llm.common import stored

SEED = 20
#: Width of the error bound in standard errors; larger reranks more and misses less.
EPSILON = 3.0
#: Vectors and queries that meet in one task.
INDEX_BLOCK, QUERY_BLOCK = 16_384, 2048
#: Queries whose estimates are held at once.
STEP = 64


@functools.lru_cache(4)
def rotation(dim: int) -> np.ndarray:
    """Random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id``, ``v`` (doubles), ``dim`` of the rows that take part: an id, and finite components that are not all zero."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x))
    return rows.filter(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)).withColumn("dim", F.size("v"))


def encode(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, norms and correction factors of the rows."""
    norm = np.linalg.norm(v, axis=1)
    turned = (v / norm[:, None]).astype(np.float32) @ rotation(v.shape[1]).T
    bits = turned > 0
    factor = np.abs(turned).sum(1) / np.sqrt(v.shape[1])
    return np.packbits(bits, axis=1), norm, factor


def index(vectors: DataFrame) -> DataFrame:
    """Adds ``code``, ``norm``, ``factor`` to every usable vector."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            flat = batch.column(1).flatten().to_numpy()
            ends = np.cumsum(dims)
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                v = flat[(ends[own] - dim)[:, None] + np.arange(dim)]
                code, norm, factor = encode(v)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(own)), batch.column(1).take(pa.array(own)), batch.column(2).take(pa.array(own)),
                    pa.array([c.tobytes() for c in code], pa.binary()), pa.array(norm), pa.array(factor.astype(np.float64))],
                    names=["vec_id", "v", "dim", "code", "norm", "factor"])

    return vectors.select("vec_id", "v", "dim").mapInArrow(work, "vec_id long, v array<double>, dim int, code binary, norm double, factor double")


def search_block(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows of one block for each of its queries. Equal vectors are compared once and listed by id."""
    none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
    if not len(queries) or not len(rows):
        return none
    rows = rows.sort_values("vec_id").drop_duplicates("vec_id")
    v = np.stack(rows["v"].to_numpy())
    ids, dim = rows["vec_id"].to_numpy(), v.shape[1]
    _, first, same = np.unique(np.ascontiguousarray(v).view(np.dtype((np.void, v.dtype.itemsize * dim))).ravel(), return_index=True, return_inverse=True)
    # of equal vectors only the k + 1 smallest ids can be among the k best of a query
    order = np.lexsort((ids, same))
    starts = np.searchsorted(same[order], np.arange(len(first)))
    members = [ids[order[a:b]][:k + 1] for a, b in zip(starts, np.append(starts[1:], len(ids)))]
    v, norm, factor = v[first], rows["norm"].to_numpy()[first], rows["factor"].to_numpy()[first]
    code = np.frombuffer(b"".join(rows["code"].to_numpy()[first]), np.uint8).reshape(len(first), -1)
    signs = (np.unpackbits(code, axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dim))
    scale = (norm / factor).astype(np.float32)
    slack = (EPSILON * norm * np.sqrt(np.maximum(1 - factor ** 2, 0)) / factor / np.sqrt(max(dim - 1, 1))).astype(np.float32)
    asked, q = queries["vec_id"].to_numpy(), np.stack(queries["v"].to_numpy())
    out: list[pd.DataFrame] = []
    for lo in range(0, len(q), STEP):
        part = q[lo:lo + STEP]
        size = np.linalg.norm(part, axis=1).astype(np.float32)[:, None]
        guess = (part.astype(np.float32) @ rotation(dim).T) @ signs.T * scale
        reach = slack[None, :] * size
        if guess.shape[1] > k + 1:
            low = guess - reach
            bar = np.partition(low, -(k + 1), axis=1)[:, -(k + 1)][:, None]  # one more, as the query's own may be among them
            keep = guess + reach >= bar
        else:
            keep = np.ones_like(guess, bool)
        for j in range(len(part)):
            at = np.flatnonzero(keep[j])
            exact = v[at] @ part[j]
            if len(at) > k + 1:
                cut = np.partition(exact, -(k + 1))[-(k + 1)]
                at, exact = at[exact >= cut], exact[exact >= cut]
            own = [members[x] for x in at]
            vec = np.concatenate(own)
            score = np.repeat(exact, [len(x) for x in own])
            other = vec != asked[lo + j]
            vec, score = vec[other], score[other]
            best = np.lexsort((vec, -score))[:k]
            out.append(pd.DataFrame({"query_id": asked[lo + j], "vec_id": vec[best], "score": score[best]}))
    return pd.concat(out)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per query its ``k`` nearest other vectors: ``query_id``, ``rank``, ``vec_id``, ``score``; ties go to the smaller id.

    Rows without id, and vectors that are null, zero or hold null or non-finite components, take no part. Only vectors of
    one length are compared. Rows that repeat an id count once. Fewer than ``k`` candidates are all returned; empty
    tables give an empty table. Other columns are not read.

    Queries and vectors meet in blocks of bounded size that are dealt by a hash of the id, so equal vectors spread over all.
    """
    built = stored(index(usable(vectors, id_col, vec_col)), "codes")
    asked = usable(queries, id_col, vec_col).dropDuplicates(["vec_id"])
    n, n_asked = built.count(), asked.count()
    blocks, query_blocks = max(1, -(-n // INDEX_BLOCK)), max(1, -(-n_asked // QUERY_BLOCK))
    # one spread of ids over blocks, finer than what meets, so that no block is much larger than the others
    by_row = built.withColumns({"b": F.pmod(F.xxhash64("vec_id"), F.lit(blocks)), "qb": F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))})
    by_query = asked.withColumns({"qb": F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(query_blocks)).cast("int"), "b": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))})
    met = by_query.groupBy("b", "qb", "dim").cogroup(by_row.groupBy("b", "qb", "dim")).applyInPandas(
        lambda q, r: search_block(q, r, k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
