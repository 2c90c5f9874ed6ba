"""Group records that share a signature, directly or through others.

A record lists the signatures under which it counts as "the same". Two records with a common
signature are linked; groups are the connected components. Work is linear in (record, signature)
rows: every signature is reduced to its smallest label, and no pair of records is ever built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlens.session import materialise


def drop_one_token(words: Column) -> Column:
    """Signatures of a sorted word set: the whole set, and the set without each word in turn.

    Two titles share one exactly when their word sets are equal or differ by one added,
    removed or exchanged word. Sets of one or two words are not shortened.
    """
    reduced = F.transform(words, lambda w: F.concat_ws(" ", F.array_remove(words, w)))
    whole = F.array(F.concat_ws(" ", words))
    return F.concat(whole, F.when(F.size(words) > 2, reduced).otherwise(F.array()))


def drop_one_char(name: Column, min_length: int = 5) -> Column:
    """Signatures of a name: itself, and itself without each character in turn that is no digit.

    Names with different digits never share one. Names below ``min_length`` characters only match exactly.
    """
    positions = F.sequence(F.lit(1), F.length(name))
    positions = F.filter(positions, lambda i: ~F.substring(name, i, F.lit(1)).rlike("[0-9]"))
    reduced = F.transform(positions, lambda i: F.concat(F.substring(name, F.lit(1), i - 1), F.substring(name, i + 1, F.length(name))))
    return F.array_distinct(F.concat(F.array(name), F.when(F.length(name) >= min_length, reduced).otherwise(F.array())))


def link_by_signature(df: DataFrame, node: str, signatures: Column) -> DataFrame:
    """``(node, root)`` with ``root`` the smallest node of each connected group.

    Each round takes the smallest label over the signatures of a node and then follows that label
    one step further (pointer jumping), so long chains fold in few rounds. Every round is
    checkpointed; labels only ever fall, so the loop ends, which it does when none changed.
    """
    links = materialise(df.select(F.col(node).alias("_n"), F.explode(signatures).alias("_s")).distinct())
    labels = df.select(F.col(node).alias("_n")).distinct().withColumn("_l", F.col("_n"))
    while True:
        by_sig = links.join(labels, "_n").groupBy("_s").agg(F.min("_l").alias("_m"))
        near = links.join(by_sig, "_s").groupBy("_n").agg(F.min("_m").alias("_m"))
        stepped = labels.join(near, "_n", "left").select(
            "_n", F.col("_l").alias("_old"), F.least("_l", F.coalesce("_m", "_l")).alias("_l"))
        parents = stepped.select(F.col("_n").alias("_l"), F.col("_l").alias("_p"))
        stepped = materialise(stepped.join(parents, "_l").select("_n", "_old", F.least("_l", "_p").alias("_l")))
        labels = stepped.select("_n", "_l")
        if stepped.filter(F.col("_l") != F.col("_old")).isEmpty():
            return labels.select(F.col("_n").alias(node), F.col("_l").alias("root"))
