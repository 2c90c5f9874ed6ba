"""Integrity gates. Each returns the offending rows or a small report, never raises on data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pk_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def null_violations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Null count per required column, in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in cols])
    return counts.select(F.inline(pairs))


def fk_orphans(fact: DataFrame, dim: DataFrame, key: str, dim_key: str | None = None) -> DataFrame:
    """Fact keys without a dimension row, with the number of fact rows each.

    The fact is reduced to distinct keys first, so a hot key costs one row in the join.
    """
    keys = fact.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("fact_rows"))
    known = dim.select(F.col(dim_key or key).alias(key))
    return keys.join(known, key, "left_anti")


def orphan_report(links: Sequence[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """One row per declared link: (name, fact, fact key, dimension, dimension key)."""
    rows = [
        fk_orphans(fact, dim, key, dim_key).agg(
            F.count(F.lit(1)).alias("orphan_keys"), F.coalesce(F.sum("fact_rows"), F.lit(0)).alias("orphan_rows"))
        .withColumn("link", F.lit(name))
        for name, fact, key, dim, dim_key in links
    ]
    return reduce(DataFrame.unionByName, rows).select("link", "orphan_keys", "orphan_rows")


def check_schema(df: DataFrame, contract: T.StructType) -> DataFrame:
    """Columns that are missing, extra or of another type than the contract says."""
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    want = {f.name: f.dataType.simpleString() for f in contract}
    rows = [
        (name, want.get(name), have.get(name),
         "missing" if name not in have else "extra" if name not in want else "type")
        for name in sorted(set(have) | set(want)) if have.get(name) != want.get(name)
    ]
    return df.sparkSession.createDataFrame(rows, "column_name string, expected string, actual string, problem string")


def assert_anchors(df: DataFrame, anchors: DataFrame, key: str, tol: float = 0.01) -> DataFrame:
    """Known-good rows that the frame misses or contradicts.

    Numeric fields may differ by less than ``tol``; other fields must be equal.
    """
    fields = [c for c in anchors.columns if c != key]
    got = df.select(key, *[F.col(c).alias(f"_got_{c}") for c in fields])
    joined = anchors.join(got, key, "left")
    numeric = {f.name for f in anchors.schema if isinstance(f.dataType, T.NumericType)}

    def failed(c: str) -> Column:
        g = F.col(f"_got_{c}")
        ok = F.abs(g.cast("double") - F.col(c).cast("double")) < F.lit(tol) if c in numeric else g.eqNullSafe(F.col(c))
        return ~F.coalesce(ok, F.lit(False))

    rows = F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("expected"),
                 F.col(f"_got_{c}").cast("string").alias("actual"), failed(c).alias("_bad"))
        for c in fields
    ])
    return joined.select(key, F.inline(rows)).filter("_bad").drop("_bad")


def verify(metrics: DataFrame, expected: DataFrame, tol: float = 0.05) -> DataFrame:
    """Published numbers that the recomputed ``(metric, value)`` rows do not reproduce."""
    joined = expected.withColumnRenamed("value", "expected").join(
        metrics.withColumnRenamed("value", "actual"), "metric", "left")
    off = F.abs(F.col("actual") - F.col("expected")) > F.lit(tol)
    return joined.filter(F.col("actual").isNull() | off)


def metric_rows(values: Mapping[str, tuple[DataFrame, Column]]) -> DataFrame:
    """``(metric, value)`` rows, one aggregation per source frame."""
    by_frame: dict[int, tuple[DataFrame, list[tuple[str, Column]]]] = {}
    for name, (df, agg) in values.items():
        by_frame.setdefault(id(df), (df, []))[1].append((name, agg))
    rows = []
    for df, aggs in by_frame.values():
        pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n, _ in aggs])
        rows.append(df.agg(*[a.cast("double").alias(n) for n, a in aggs]).select(F.inline(pairs)))
    return reduce(DataFrame.unionByName, rows)


def citation_check(claims: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """Claims that cite an id which no evidence row carries."""
    return claims.filter(F.col(key).isNotNull()).join(evidence.select(key), key, "left_anti")
