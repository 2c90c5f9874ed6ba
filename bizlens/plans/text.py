"""Text: cleaning, same-story clusters, alias folding, entity tags, search and vector retrieval."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bizlens.functions.textual import cosine, is_junk_title, mentions_any, name_similarity, normalise_name, relabel_language, repair_mojibake, token_jaccard, tokens
from bizlens.operators.linking import drop_one_char, drop_one_token, link_by_signature
from bizlens.operators.similarity import components, edit_pairs, jaccard_pairs

QUERY_BATCH = 64


def title_of(html: Column | str) -> Column:
    """Title element of a page, read from the whole page."""
    raw = F.regexp_extract(F.col(html) if isinstance(html, str) else html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.trim(F.regexp_replace(raw, r"\s+", " "))


def host_of(url: Column | str) -> Column:
    c = F.col(url) if isinstance(url, str) else url
    return F.lower(F.regexp_extract(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)", 1))


def clean(df: DataFrame, title: str = "title", lang: str = "lang", source: str | None = None) -> DataFrame:
    """Drop page furniture, repair broken letters, relabel mistagged scripts."""
    out = df.filter(~is_junk_title(title)).withColumn(title, repair_mojibake(title))
    if source:
        out = out.withColumn(source, repair_mojibake(source))
    return out.withColumn(lang, relabel_language(title, lang))


def cluster_titles(df: DataFrame, key: str, title: str, thr: float = 0.5) -> DataFrame:
    """Same-story clusters: ``(key, title, cluster, cluster_size)``.

    Candidates are titles whose word sets are equal or differ by one word, followed over chains; each is then compared with
    the first title of its chain and stays with it only if their word sets have a Jaccard similarity of ``thr`` or
    more, else it stands with its copies alone. Equal titles are folded before the linking, so copies of any number cost one
    row there. Records without a word keep to themselves.
    """
    norm = F.concat_ws(" ", F.array_sort(F.array_distinct(tokens(title))))
    keyed = df.select(key, title).withColumn("_norm", norm)
    distinct = keyed.filter("_norm <> ''").groupBy("_norm").agg(F.min(key).alias("_node"))
    worded = distinct.withColumn("_words", F.split("_norm", " "))
    roots = link_by_signature(worded, "_node", drop_one_token(F.col("_words")))
    first = worded.select(F.col("_node").alias("root"), F.col("_words").alias("_first"))
    linked = worded.join(roots, "_node").join(first, "root")
    near = token_jaccard(F.col("_words"), F.col("_first")) >= thr
    by_norm = linked.select("_norm", F.when(near, F.col("root")).otherwise(F.col("_node")).alias("cluster"))
    tagged = keyed.join(by_norm, "_norm", "left").withColumn("cluster", F.coalesce("cluster", F.col(key)))
    sizes = tagged.groupBy("cluster").agg(F.count(F.lit(1)).alias("cluster_size"))
    return tagged.join(sizes, "cluster").select(key, title, "cluster", "cluster_size")


def resolve_entities(df: DataFrame, name: str, aliases: DataFrame | None = None, thr: float = 0.75) -> DataFrame:
    """Fold spelling variants: ``(name, canonical, mentions)``.

    Names are normalised (case, punctuation, legal form at the end); known ``aliases`` (``alias``, ``canonical``)
    are applied, which covers initials and trade names; then names that become equal by leaving out at most
    one character each (no digit) are linked over chains. The canonical form of a group is its most mentioned name; a name whose
    normal form is less than ``thr`` similar to the canonical one's (edit distance over length) leaves the group
    with the names of its own normal form.
    """
    counted = df.filter(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("mentions"))
    normed = counted.withColumn("_norm", normalise_name(name))
    if aliases is not None:
        known = aliases.select(normalise_name("alias").alias("_norm"), normalise_name("canonical").alias("_to"))
        normed = normed.join(known, "_norm", "left").withColumn("_norm", F.coalesce("_to", "_norm")).drop("_to")
    forms = normed.groupBy("_norm").agg(F.max_by(name, F.struct("mentions", name)).alias("_own"), F.max("mentions").alias("_m"))
    roots = link_by_signature(forms.select("_norm"), "_norm", drop_one_char(F.col("_norm")))
    grouped = forms.join(roots, "_norm")
    best = grouped.groupBy("root").agg(F.max_by(F.struct("_own", "_norm"), F.struct("_m", "_own")).alias("_best"))
    near = name_similarity("_norm", "_best._norm") >= thr
    named = grouped.join(best, "root").select("_norm", F.when(near, F.col("_best._own")).otherwise(F.col("_own")).alias("canonical"))
    return normed.join(named, "_norm").select(name, "canonical", "mentions")


def cluster_titles_jaccard(df: DataFrame, key: str, title: str, least_pct: int = 50) -> DataFrame:
    """Same-story clusters by a set-similarity join: ``(key, title, cluster, cluster_size)``.

    Titles link when their word sets reach a Jaccard similarity of ``least_pct`` percent (verified on whole sets);
    a cluster is a component of such links, named by its smallest key. Equal word sets are folded first, so copies
    of any number cost one row; records without a word keep to themselves.
    """
    keyed = df.select(key, title).withColumn("_norm", F.concat_ws(" ", F.array_sort(F.array_distinct(tokens(title)))))
    distinct = keyed.filter("_norm <> ''").groupBy("_norm").agg(F.min(key).alias("_node"))
    pairs = jaccard_pairs(distinct.select("_node", F.split("_norm", " ").alias("_w")), "_node", "_w", least_pct)
    roots = components(distinct.select("_node"), "_node", pairs)
    by_norm = distinct.join(roots, "_node").select("_norm", F.col("root").alias("cluster"))
    tagged = keyed.join(by_norm, "_norm", "left").withColumn("cluster", F.coalesce("cluster", F.col(key)))
    sizes = tagged.groupBy("cluster").agg(F.count(F.lit(1)).alias("cluster_size"))
    return tagged.join(sizes, "cluster").select(key, title, "cluster", "cluster_size")


def resolve_names_edit(df: DataFrame, name: str, least_pct: int = 75) -> DataFrame:
    """Fold spelling variants by an edit-similarity join: ``(name, canonical, mentions)``.

    Normal forms (case, punctuation, legal form) link when their edit similarity ``1 - lev / longer length`` is at
    least ``least_pct`` percent, at any length; a group is a component of such links, and its canonical name is its
    most mentioned one (ties: the larger name). Null names are not counted.
    """
    counted = df.filter(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("mentions"))
    normed = counted.withColumn("_norm", normalise_name(name))
    forms = normed.select("_norm").distinct()
    roots = components(forms, "_norm", edit_pairs(forms, "_norm", least_pct))
    grouped = normed.join(roots, "_norm")
    best = grouped.groupBy("root").agg(F.max_by(name, F.struct("mentions", name)).alias("canonical"))
    return grouped.join(best, "root").select(name, "canonical", "mentions")


def ngrams(words: Column, n: int) -> Column:
    """All runs of ``n`` words; ``words`` must be a plain column, or it is recomputed per run."""
    if n == 1:
        return words
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array())
    return F.transform(starts, lambda i: F.concat_ws(" ", F.slice(words, i, n)))


def tag_entities(docs: DataFrame, key: str, text: str, gazetteer: DataFrame, stop: DataFrame | None = None, upto: int = 1) -> DataFrame:
    """Gazetteer terms found in each whole text: ``(key, term, entity, hits)``.

    Terms are counted per text before the join, so a word repeated all over costs one row per text. Generic
    terms in ``stop`` are rejected.
    """
    words = docs.select(key, tokens(text).alias("_w"))
    runs = F.concat(*[ngrams(F.col("_w"), n) for n in range(1, upto + 1)])
    found = words.select(key, F.explode(runs).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("hits"))
    terms = gazetteer if stop is None else gazetteer.join(stop, "term", "left_anti")
    return found.join(terms, "term").select(key, "term", "entity", "hits")


def keyword_search(df: DataFrame, terms: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.filter(mentions_any(list(cols), list(terms)))


def topk_cosine(corpus: DataFrame, vector: Sequence[float], k: int = 10, key: str = "vec_id", emb: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows to one query vector: a scan with a per-task heap."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    return corpus.select(key, F.round(cosine(emb, q), 6).alias("similarity")).orderBy(F.col("similarity").desc(), F.col(key)).limit(k)


def topk_cosine_many(queries: DataFrame, corpus: DataFrame, k: int = 10, query_key: str = "query_id",
                     key: str = "vec_id", emb: str = "embedding") -> DataFrame:
    """The ``k`` nearest corpus rows of every query, exact.

    Query vectors are read in batches of ``QUERY_BATCH`` and travel as plan literals; each batch is one scan
    of the corpus. The rank filter is applied before the shuffle, so at most ``k`` rows
    per task and query move. Meant for question-sized query sets, not for joining two corpora.
    """
    out = None
    batch: list = []

    def scan(rows: list) -> DataFrame:
        literal = F.array(*[F.struct(F.lit(r[0]).alias("q"), F.array(*[F.lit(float(x)) for x in r[1]]).alias("v")) for r in rows])
        scored = corpus.select(key, emb, F.explode(literal).alias("_q")).select(
            F.col("_q.q").alias(query_key), key, F.round(cosine(emb, F.col("_q.v")), 6).alias("similarity"))
        w = Window.partitionBy(query_key).orderBy(F.col("similarity").desc(), F.col(key))
        return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    for row in queries.select(query_key, emb).toLocalIterator():
        batch.append((row[0], row[1]))
        if len(batch) == QUERY_BATCH:
            out = scan(batch) if out is None else out.unionByName(scan(batch))
            batch = []
    if batch:
        out = scan(batch) if out is None else out.unionByName(scan(batch))
    if out is None:
        raise ValueError("no query vectors")
    return out


def approx_topk_cosine(corpus: DataFrame, vector: Sequence[float], k: int = 10, key: str = "vec_id", emb: str = "embedding",
                       tables: int = 8, width: float = 1.0, seed: int = 7) -> DataFrame:
    """The nearest rows to one query vector among those that share a hash bucket with it.

    Trades recall for a smaller scan: on unit vectors the Euclidean order of the hash model is the cosine
    order. :func:`topk_cosine` is the exact form.
    """
    norm = F.sqrt(F.aggregate(emb, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    unit = corpus.withColumn("_n", norm).filter("_n > 0").select(
        key, array_to_vector(F.transform(emb, lambda x: x.cast("double") / F.col("_n"))).alias("_u"))
    length = sum(float(x) * float(x) for x in vector) ** 0.5
    probe = Vectors.dense([float(x) / length for x in vector])
    model = BucketedRandomProjectionLSH(inputCol="_u", outputCol="_h", bucketLength=width, numHashTables=tables, seed=seed).fit(unit)
    near = model.approxNearestNeighbors(unit, probe, k, distCol="_d")
    return near.select(key, F.round(F.lit(1.0) - F.col("_d") * F.col("_d") / 2.0, 6).alias("similarity"))
