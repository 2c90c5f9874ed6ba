"""Queries of this package: name -> (Spark callable, equivalent SQL or None)."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlens.llm import bpe, exact_dedup, filter_audit, language, lm_score, minhash, packing, phrases, quality, quotes, rabitq, simhash, suffix_dedup
from bizlens.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    """Path of an installed public tokenizer file; ``TOKENIZER_DIR`` names another folder."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_rabitq(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return rabitq.nearest(vectors, vectors.filter("vec_id % 20 = 0"), 20)


def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return language.identify(docs, language.fit(docs))


def op3_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    return lm_score.score(table(spark, folder, "documents"))


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.classify(docs, quality.fit(docs, table(spark, folder, "labels")))


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"), width=4, distance=4)


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"), 4096)


def op7_quotes(spark: SparkSession, folder: str) -> DataFrame:
    found = quotes.link_quotes(table(spark, folder, "conversations"))
    return found.select("conv_id", "turn", "position", "reply_to", "thread", "depth", "n_quoted", F.sha2("text", 256).alias("own_sha256"))


def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, folder, "documents"))


def op9_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, folder, "documents"), window=100)


def op10_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_decode(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"))


def op11_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.mine(table(spark, folder, "documents"), least=100, top=2000)


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    table(spark, folder, "documents")
    return filter_audit.audit(spark, f"{folder}/documents.parquet", table(spark, folder, "labels"))


def op13_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"), width=2, least=0.8)


OP8_SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM n
"""

OP11_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), p AS (
  SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d
), w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p
), g AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, ws, unnest([1, 2, 3, 4, 5]) AS k FROM w) s, LATERAL (SELECT unnest(range(1, len(ws) - k + 2)) AS i) q
), f AS (
  SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase
), tot AS (
  SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang
), cand AS (
  SELECT lang, k, phrase, f AS a FROM f WHERE k >= 2 AND f >= 100
), kept AS (
  SELECT c.* FROM cand c WHERE NOT EXISTS (
    SELECT 1 FROM cand o WHERE o.lang = c.lang AND o.k > c.k AND o.a >= c.a AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' '))
), cuts AS (
  SELECT c.lang, c.phrase, c.a, j AS cut, string_split(c.phrase, ' ') AS ws, c.k FROM kept c, LATERAL (SELECT unnest(range(1, c.k)) AS j) q
), scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, cuts.cut, fl.f AS l, fr.f AS r, tot.n,
         (CAST(1000 AS HUGEINT) * cuts.a * tot.n) // (CAST(fl.f AS HUGEINT) * fr.f) AS score
  FROM cuts
  JOIN f fl ON fl.lang = cuts.lang AND fl.phrase = array_to_string(cuts.ws[1:cuts.cut], ' ')
  JOIN f fr ON fr.lang = cuts.lang AND fr.phrase = array_to_string(cuts.ws[cuts.cut + 1:cuts.k], ' ')
  JOIN tot ON tot.lang = cuts.lang
), best AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM scored
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best WHERE o = 1
)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000
"""

OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, part, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d
), lab AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
), m AS (
  SELECT w.part,
    (CASE WHEN len(w.ws) < 100 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * len(list_distinct(w.ws)) < 80 * len(w.ws) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * (length(w.t) - length(regexp_replace(w.t, '[A-Z]', '', 'g'))) > 10 * length(w.t) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(w.t, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY w.t) THEN 16 ELSE 0 END) AS mask,
    coalesce(lab.good, 0) AS good, coalesce(lab.toxic, 0) AS toxic
  FROM w LEFT JOIN lab ON w.doc_id = lab.doc_id
), h AS (
  SELECT part, mask, count(*) AS n, sum(good) AS g, sum(toxic) AS x FROM m GROUP BY part, mask
), f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), p AS (
  SELECT f1.letter || f2.letter || f3.letter || f4.letter || f5.letter AS filter_order, f1.bit AS b1, f2.bit AS b2, f3.bit AS b3, f4.bit AS b4, f5.bit AS b5
  FROM f f1, f f2, f f3, f f4, f f5 WHERE f1.bit + f2.bit + f3.bit + f4.bit + f5.bit = 31
), s AS (
  SELECT filter_order, 1 AS step, b1 AS fb, 0 AS earlier FROM p
  UNION ALL SELECT filter_order, 2, b2, b1 FROM p
  UNION ALL SELECT filter_order, 3, b3, b1 + b2 FROM p
  UNION ALL SELECT filter_order, 4, b4, b1 + b2 + b3 FROM p
  UNION ALL SELECT filter_order, 5, b5, b1 + b2 + b3 + b4 FROM p
), sh AS (
  SELECT h.part, f.bit AS fb, sum(h.n * (120 // bit_count(h.mask))) AS shapley FROM h, f WHERE (h.mask & f.bit) <> 0 GROUP BY h.part, f.bit
)
SELECT h.part, s.filter_order, CAST(s.step AS INTEGER) AS step,
  CAST(coalesce(sum(h.n) FILTER (WHERE (h.mask & (s.earlier | s.fb)) = 0), 0) AS BIGINT) AS kept,
  CAST(coalesce(sum(h.n) FILTER (WHERE (h.mask & s.fb) <> 0 AND (h.mask & s.earlier) = 0), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(h.n) FILTER (WHERE (h.mask & s.fb) <> 0 AND (h.mask & s.earlier) <> 0), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(h.n) FILTER (WHERE h.mask = s.fb), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(h.g) FILTER (WHERE (h.mask & s.fb) <> 0 AND (h.mask & s.earlier) = 0), 0) AS BIGINT) AS good_lost,
  CAST(coalesce(sum(h.x) FILTER (WHERE (h.mask & s.fb) <> 0 AND (h.mask & s.earlier) = 0), 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(max(sh.shapley), 0) AS BIGINT) AS shapley
FROM h CROSS JOIN s LEFT JOIN sh ON sh.part = h.part AND sh.fb = s.fb
GROUP BY h.part, s.filter_order, s.step
"""

QUERIES: dict[str, tuple[Query, str | None]] = {
    "op1_rabitq": (op1_rabitq, None),
    "op2_language": (op2_language, None),
    "op3_lm_score": (op3_lm_score, None),
    "op4_quality": (op4_quality, None),
    "op5_simhash": (op5_simhash, None),
    "op6_packing": (op6_packing, None),
    "op7_quotes": (op7_quotes, None),
    "op8_exact_dedup": (op8_exact_dedup, OP8_SQL),
    "op9_suffix_dedup": (op9_suffix_dedup, None),
    "op10_bpe": (op10_bpe, None),
    "op11_phrases": (op11_phrases, OP11_SQL),
    "op12_filter_audit": (op12_filter_audit, OP12_SQL),
    "op13_minhash": (op13_minhash, None),
}
