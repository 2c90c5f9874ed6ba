"""A corpus pipeline from raw documents to packed sequences, one stage per dealt operator.

Each stage reads what the one before kept. Rows are identified by id and text, so different texts of one
id are judged apart, and equal rows of one id are copies of each other. All stages but the last return the columns
of ``documents``; ``n_chars`` follows the text where a stage changes it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlens.llm import exact_dedup, packing, quality, simhash, suffix_dedup
from bizlens.llm.common import ship, stored, table
from bizlens.llm.registry import vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
NO_ID = (1 << 63) - 1


def _one_each(docs: DataFrame, kept: DataFrame, text_key) -> DataFrame:
    """The rows of ``docs`` named in ``kept`` (``doc_id``, ``mark``), once each; ``text_key`` gives the mark of a text."""
    ids = stored(kept.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_kept_id"), F.col("mark").alias("_kept_mark")).groupBy("_kept_id", "_kept_mark").agg(F.count(F.lit(1))), "kept").drop("count(1)")
    marked = docs.withColumns({"_own_id": F.coalesce("doc_id", F.lit(NO_ID)), "_own_mark": text_key})
    found = marked.join(ids, (F.col("_own_id") == F.col("_kept_id")) & (F.col("_own_mark") == F.col("_kept_mark")), "left_semi")
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not repeated.isEmpty():  # equal rows of one id: any one of them
        found = found.dropDuplicates(["_own_id", "_own_mark"])
    return found.select(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    ship(spark)
    params = quality.Params()
    model = quality.fit(docs, table(spark, sf_dir, "labels"), params)
    return docs.filter(quality.score_column(model, F.col("text"), params) >= params.accept)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id."""
    ship(spark)
    found = exact_dedup.exact_dedup(docs).filter("kept").select("doc_id", F.col("text_sha256").alias("mark"))
    return _one_each(docs, found, F.sha2(exact_dedup.normalised(F.coalesce("text", F.lit(""))), 256))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the smallest id, and of several texts with this id the smallest hash."""
    ship(spark)
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    found = simhash.near_duplicates(docs, width=4, distance=4, carry=(text_hash.alias("mark"),))
    least = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    one = least.groupBy("root").agg(F.min("doc_id").alias("doc_id"), F.min("mark").alias("mark"))
    return _one_each(docs, one.select("doc_id", "mark"), text_hash)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 100 bytes or more that start earlier in the corpus."""
    ship(spark)
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    renamed = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), *[F.col(c).alias(f"_c_{c}") for c in others])
    cut = suffix_dedup.remove_repeats(renamed, window=100, id_col="_id", text_col="_text", with_text=True, carry=tuple(f"_c_{c}" for c in others))
    kept = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.col("kept")} | {c: F.col(f"_c_{c}") for c in others}
    if "n_chars" in others:
        kept["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_c_n_chars"))
    return cut.select(*[kept[c].alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of 4096 tokens."""
    ship(spark)
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), 4096)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("best_fit_packing", pack_sequences),
]

#: SQL cannot express a trained classifier, SimHash components or bin packing; tests compare each stage with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
