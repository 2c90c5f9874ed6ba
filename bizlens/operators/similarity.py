"""Exact similarity joins by prefix filtering: word sets by Jaccard, strings by edit distance.

Both joins order the elements of every record by a global rarity (rarest first, ties by value) and keep a prefix
whose length follows from the threshold: two records that reach the threshold always share an element of both
prefixes. Records meet only through prefix elements, and only when their lengths allow the threshold; every
candidate is then verified on the whole records, so the result equals the all-pairs join. A frequent element
stands at the end of the order, so it enters few prefixes and does not multiply the pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bizlens.operators.linking import link_by_signature

PAD, MARK = "\u0001", "\u0002"


def _prefixed(elements: DataFrame, prefix: Column) -> DataFrame:
    """``(_n, _len, _t)`` rows kept when the element is among the first ``prefix`` of its record by rarity."""
    freq = elements.groupBy("_t").agg(F.count(F.lit(1)).alias("_f"))
    order = Window.partitionBy("_n").orderBy("_f", "_t")
    ranked = elements.join(freq, "_t").withColumn("_r", F.row_number().over(order))
    return ranked.filter(F.col("_r") <= prefix).select("_n", "_len", "_t")


def _candidates(prefix: DataFrame, fits: Column) -> DataFrame:
    left = prefix.select("_t", F.col("_n").alias("a"), F.col("_len").alias("la"))
    right = prefix.select("_t", F.col("_n").alias("b"), F.col("_len").alias("lb"))
    return left.join(right, "_t").filter((F.col("a") < F.col("b")) & fits).select("a", "b").distinct()


def jaccard_pairs(sets: DataFrame, node: str, items: str, least_pct: int) -> DataFrame:
    """Pairs ``(a, b)``, ``a < b``, of nodes whose distinct non-null items meet ``100 * |A & B| >= least_pct * |A | B|``.

    Empty sets and null nodes take no part. Exact for any ``least_pct`` from 1 to 100.
    """
    s = sets.filter(F.col(node).isNotNull()).select(F.col(node).alias("_n"), F.array_distinct(F.array_compact(items)).alias("_x"))
    s = s.withColumn("_len", F.size("_x")).filter("_len > 0")
    flat = s.select("_n", "_len", F.explode("_x").alias("_t"))
    keep = F.col("_len") - F.expr(f"({least_pct} * _len + 99) div 100") + 1
    fits = F.lit(least_pct) * F.greatest("la", "lb") <= F.lit(100) * F.least("la", "lb")
    pairs = _candidates(_prefixed(flat, keep), fits)
    xa = s.select(F.col("_n").alias("a"), F.col("_x").alias("xa"), F.col("_len").alias("la"))
    xb = s.select(F.col("_n").alias("b"), F.col("_x").alias("xb"), F.col("_len").alias("lb"))
    judged = pairs.join(xa, "a").join(xb, "b").withColumn("_i", F.size(F.array_intersect("xa", "xb")).cast("long"))
    return judged.filter(F.lit(100) * F.col("_i") >= F.lit(least_pct) * (F.col("la") + F.col("lb") - F.col("_i"))).select("a", "b")


def gram_size(least_pct: int) -> int:
    """2-grams when every string keeps a q-gram beyond its prefix at this threshold, else characters."""
    return 2 if 2 * (100 - least_pct) <= least_pct else 1


def edit_pairs(strings: DataFrame, value: str, least_pct: int) -> DataFrame:
    """Pairs ``(a, b)``, ``a < b``, of distinct non-null strings with ``100 * lev(a, b) <= (100 - least_pct) * longer length``
    (an edit similarity ``1 - lev / longer length`` of at least ``least_pct`` percent), at any length.

    Strings are padded and cut into q-grams, numbered by occurrence. An edit changes at most q of them, and a partner
    lies within ``d = floor(len * (100 - p) / p)`` edits, so both strings hold a common q-gram among their first
    ``q * d + 1``. For thresholds at or below 50 % characters are used and the prefix may be the whole string:
    strings without a common character have similarity 0.
    """
    q = gram_size(least_pct)
    s = strings.select(F.col(value).alias("_n")).filter(F.col("_n").isNotNull()).distinct().withColumn("_len", F.length("_n"))
    padded = F.concat(F.lit(PAD * (q - 1)), F.col("_n"), F.lit(PAD * (q - 1)))
    grams = s.select("_n", "_len", F.posexplode(F.transform(F.sequence(F.lit(1), F.col("_len") + q - 1), lambda i: F.substring(padded, i, q))).alias("_p", "_g"))
    grams = grams.filter(F.col("_len") + q - 1 > 0)
    occ = F.row_number().over(Window.partitionBy("_n", "_g").orderBy("_p"))
    flat = grams.select("_n", "_len", F.concat("_g", F.lit(MARK), occ.cast("string")).alias("_t"))
    d = F.expr(f"(_len * {100 - least_pct}) div {least_pct}")
    fits = F.lit(100) * (F.greatest("la", "lb") - F.least("la", "lb")) <= F.lit(100 - least_pct) * F.greatest("la", "lb")
    pairs = _candidates(_prefixed(flat, F.lit(q) * d + 1), fits)
    longer = F.greatest(F.length("a"), F.length("b")).cast("long")
    return pairs.filter(F.lit(100) * F.levenshtein("a", "b").cast("long") <= F.lit(100 - least_pct) * longer)


def components(nodes: DataFrame, node: str, links: DataFrame) -> DataFrame:
    """``(node, root)``: the smallest node that verified links ``(a, b)`` reach from each node, itself included."""
    ends = links.select(F.col("a").alias("_v"), F.concat_ws(MARK, F.col("a").cast("string"), F.col("b").cast("string")).alias("_s"))
    ends = ends.unionByName(links.select(F.col("b").alias("_v"), F.concat_ws(MARK, F.col("a").cast("string"), F.col("b").cast("string")).alias("_s")))
    lone = nodes.select(F.col(node).alias("_v"), F.lit(None).cast("string").alias("_s"))
    rows = ends.unionByName(lone).select("_v", F.when(F.col("_s").isNull(), F.array().cast("array<string>")).otherwise(F.array("_s")).alias("_sig"))
    return link_by_signature(rows, "_v", F.col("_sig")).select(F.col("_v").alias(node), "root")
