"""Exact deduplication by content-defined chunk recipes, with DataFrame functions only.

A text is cut at places that its own content marks, so equal stretches give equal chunks wherever they stand. Distinct
chunks are compared by content once and get identifiers that no two different chunks share; a text is then
its ordered identifier list, and texts are equal exactly when these lists are. Whole texts are read and cut once;
after that only lists of 8 bytes per chunk move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlens.llm.common import keyed, stored

#: A chunk ends behind one of these letter pairs and a space, once it has MIN characters, and at MAX at the latest.
MIN_CHARS, MAX_CHARS = 384, 4096
CHUNK = rf"(?s).{{{MIN_CHARS},{MAX_CHARS}}}?(?<=[aeiou][nrst][ ,])|.{{{MAX_CHARS}}}|.+"
NO_ID = (1 << 63) - 1


def normalised(text: Column) -> Column:
    """Each run of spaces, tabs and line ends as one space."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def _hash(chunk: Column, bits: int) -> Column:
    h = F.xxhash64(chunk)
    return h if bits == 64 else F.shiftrightunsigned(h, 64 - bits)


def chunk_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, written once: ``row`` (its number), ``doc_id``, ``text_sha256``, ``chunks``."""
    norm = keyed(docs, id_col, text_col).select("doc_id", normalised(F.col("text")).alias("norm"))
    return stored(norm.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2("norm", 256).alias("text_sha256"),
                              F.regexp_extract_all("norm", F.lit(CHUNK), F.lit(0)).alias("chunks")), "chunks")


def recipes(cut: DataFrame, bits: int = 64) -> DataFrame:
    """``row``, ``doc_id``, ``text_sha256`` and ``recipe``, the ordered list of verified chunk identifiers.

    Chunks are made distinct by their content (combined on the map side, so a chunk of a million copies moves once per
    task). Where two contents share a hash, each gets an ordinal behind the hash; that list is empty or tiny at 64
    bits, and ``bits`` lets tests fill it.
    """
    distinct = cut.select(F.explode("chunks").alias("chunk")).distinct().withColumn("h", _hash(F.col("chunk"), bits))
    doubled = stored(distinct.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "shared-hashes")
    hashes = F.transform("chunks", lambda c: _hash(c, bits))
    if doubled.isEmpty():
        return cut.select("row", "doc_id", "text_sha256", hashes.alias("recipe"))
    shared = stored(distinct.join(doubled, "h"), "shared-chunks")
    # A content's ordinal is its place among the contents of its hash, found by counting the smaller ones.
    other = shared.select("h", F.col("chunk").alias("less"))
    ordinal = shared.join(other, "h").groupBy("h", "chunk").agg(F.sum((F.col("less") < F.col("chunk")).cast("int")).alias("ordinal"))
    parts = cut.select("row", F.posexplode("chunks").alias("pos", "chunk")).withColumn("h", _hash(F.col("chunk"), bits))
    marked = parts.join(ordinal, ["h", "chunk"]).filter("ordinal > 0").groupBy("row").agg(
        F.map_from_entries(F.collect_list(F.struct("pos", "ordinal"))).alias("ordinals"))
    wide = cut.select("row", "doc_id", "text_sha256", hashes.alias("hashes")).join(marked, "row", "left")
    # The ordinals stand behind the hashes as (place, ordinal) pairs, so lists of different contents always differ.
    extra = F.flatten(F.transform(F.array_sort(F.map_entries("ordinals")), lambda e: F.array(e["key"].cast("long"), e["value"].cast("long"))))
    return wide.select("row", "doc_id", "text_sha256",
                       F.concat(F.array(F.size("hashes").cast("long")), F.col("hashes"), F.coalesce(extra, F.array().cast("array<bigint>"))).alias("recipe"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """One row per input row: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Of equal normalised texts the row with the smallest id stays. A null text counts as empty; an empty text is a text
    like any other. A null id comes after every other id (``keep_id`` is null only if all ids of the group are). Of
    repeated rows with one id, one stays. An empty table gives an empty table. Other columns are not read.

    A hot group is combined on the map side before its recipe is shuffled; the join back is a sort-merge join whose
    skewed side Spark splits.
    """
    rec = stored(recipes(chunk_table(docs, id_col, text_col), bits).withColumn("order", F.coalesce("doc_id", F.lit(NO_ID))), "recipes")
    by_id = rec.groupBy("recipe", "order").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("n"))
    groups = by_id.groupBy("recipe").agg(F.min("order").alias("keep"), F.min_by("row", "order").alias("keep_row"),
                                         F.sum("n").alias("group_size"))
    return rec.join(groups, "recipe").select(
        "doc_id", F.when(F.col("keep") != NO_ID, F.col("keep")).alias("keep_id"), "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")
