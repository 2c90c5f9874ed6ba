"""Grouping operators. Each is one partial + final aggregation unless stated otherwise."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlens.functions.metrics import rate


def segment_rates(df: DataFrame, dims: Sequence[str], flag: str, n: str = "n", hits: str = "won",
                  out: str = "win_rate_pct", digits: int = 2, min_n: int = 0) -> DataFrame:
    """Rows, flagged rows and the rate per segment; groups below ``min_n`` rows are cut (HAVING)."""
    g = df.groupBy(*dims).agg(F.count(F.lit(1)).alias(n), F.sum(flag).cast("bigint").alias(hits))
    g = g.withColumn(out, rate(hits, n, digits=digits))
    return g.filter(F.col(n) >= min_n) if min_n else g


def crosstab(df: DataFrame, row: str, column: str, values: Sequence, measure: Column) -> DataFrame:
    """Wide matrix; ``values`` fixes the columns, so Spark needs no extra pass to find them."""
    return df.groupBy(row).pivot(column, list(values)).agg(measure)


def with_totals(df: DataFrame, dims: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Detail, subtotal and grand-total rows; ``level`` 0 is detail. Ratios are recomputed per level."""
    return df.rollup(*dims).agg(F.grouping_id().cast("int").alias("level"), *aggs)


def histogram(df: DataFrame, value: str, lo: float, hi: float, bins: int,
              by: Sequence[str] = (), n: str = "n") -> DataFrame:
    """Equal-width bins over ``[lo, hi]``, numbered from 0; the top edge belongs to the last bin."""
    width = (hi - lo) / bins
    idx = F.least(F.floor((F.col(value).cast("double") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))
    inside = df.filter(F.col(value).between(lo, hi)).withColumn("bin", idx.cast("int"))
    g = inside.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias(n))
    return g.withColumn("bin_lo", F.lit(float(lo)) + F.col("bin") * F.lit(width))


def by_month(df: DataFrame, date: str, aggs: Sequence[Column], label: str = "month") -> DataFrame:
    return df.groupBy(F.trunc(F.col(date), "MM").alias(label)).agg(*aggs)


def collapse_to_grain(child: DataFrame, key: str | Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """One row per parent key, so a later join cannot multiply parent rows."""
    keys = [key] if isinstance(key, str) else list(key)
    return child.groupBy(*keys).agg(*aggs)


def drill_across(dim: DataFrame, facts: Mapping[str, tuple[DataFrame, Sequence[Column]]], key: str) -> DataFrame:
    """Several facts against one dimension, each aggregated to the dimension key before its join."""
    out = dim
    for fact, aggs in facts.values():
        out = out.join(collapse_to_grain(fact, key, aggs), key, "left")
    return out


def stack_steps(steps: Sequence[tuple[str, DataFrame, Column]], label: str = "step", value: str = "records") -> DataFrame:
    """One labelled row per (name, frame, aggregate), with the step order kept as a column."""
    rows = [
        df.agg(agg.cast("bigint").alias(value)).select(
            F.lit(i).alias("step_order"), F.lit(name).alias(label), F.coalesce(F.col(value), F.lit(0)).alias(value))
        for i, (name, df, agg) in enumerate(steps, start=1)
    ]
    return reduce(DataFrame.unionByName, rows)


def one_row(parts: Sequence[tuple[DataFrame, Mapping[str, Column]]]) -> DataFrame:
    """Aggregates of several frames side by side in one row.

    The one-row results are stacked and folded with ``max``: no cross join is needed.
    """
    names = [n for _, aggs in parts for n in aggs]
    rows = [df.agg(*[c.alias(n) for n, c in aggs.items()]) for df, aggs in parts]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return stacked.agg(*[F.max(n).alias(n) for n in names])


def unpivot_row(df: DataFrame, names: Sequence[str], key: str, value: str) -> DataFrame:
    """Turn the columns of a narrow frame into (key, value) rows."""
    pairs = F.array(*[F.struct(F.lit(n).alias(key), F.col(n).alias(value)) for n in names])
    keep = [c for c in df.columns if c not in names]
    return df.select(*keep, F.inline(pairs))
