"""Join shapes. Join strategy is left to the optimizer: dimensions below
``spark.sql.autoBroadcastJoinThreshold`` are broadcast, larger ones are shuffled, skew is split by AQE."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_dim(fact: DataFrame, dim: DataFrame, key: str | Sequence[str], how: str = "inner") -> DataFrame:
    return fact.join(dim, key, how)


def star_join(fact: DataFrame, dims: Mapping[str, DataFrame], how: str = "inner") -> DataFrame:
    """Join every dimension on its key column."""
    out = fact
    for key, dim in dims.items():
        out = out.join(dim, key, how)
    return out


def join_date(fact: DataFrame, dim_date: DataFrame, role: str, how: str = "inner") -> DataFrame:
    """Join the calendar on the chosen role key (created, won, lost, recognition ...)."""
    return fact.join(dim_date.withColumnRenamed("date_key", role), role, how)


def cohort(parents: DataFrame, children: DataFrame, key: str, cond: Column) -> DataFrame:
    """Parents with at least one child that satisfies ``cond``."""
    return parents.join(children.filter(cond).select(key), key, "left_semi")


def reconcile_sums(lhs: DataFrame, rhs: DataFrame, keys: Sequence[str], left: str, right: str,
                   tol: float, out: str = "resummed") -> DataFrame:
    """Rows of ``lhs`` whose total differs from the re-summed detail by more than ``tol``."""
    detail = rhs.groupBy(*keys).agg(F.sum(right).alias(out))
    joined = lhs.join(detail, list(keys), "left").withColumn(out, F.coalesce(F.col(out), F.lit(0)))
    return joined.filter(F.abs(F.col(left) - F.col(out)) > F.lit(tol))


def scenario_grid(plan: DataFrame, values: Sequence[float], name: str) -> DataFrame:
    """Every plan row under every parameter value.

    The grid is a fixed literal array exploded per row, so there is no join at all.
    """
    return plan.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))
