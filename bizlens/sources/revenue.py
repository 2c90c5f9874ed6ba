"""Staging rows to the canonical revenue fact."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlens.functions.bands import in_set, recode


@dataclass(frozen=True)
class RevenueRules:
    """How staged invoice lines are classified; rules are data."""

    buckets: Mapping[str, Iterable[str]]
    default_bucket: str = "Other"
    core_buckets: Iterable[str] = ("Product",)
    paid_states: Iterable[str] = ("paid",)
    columns: Mapping[str, str] = field(default_factory=dict)


def build_revenue_fact(staging: DataFrame, rules: RevenueRules) -> DataFrame:
    """Bucket, core flag and confirmed amount of every staged line.

    Needs ``line_class``, ``payment_state``, ``amount_expected`` and ``cost``; cost counts only for
    core lines, and an amount is confirmed in full once paid.
    """
    renamed = staging.withColumnsRenamed(dict(rules.columns))
    bucketed = renamed.withColumn("bucket_key", recode("line_class", rules.buckets, rules.default_bucket))
    core = in_set("bucket_key", rules.core_buckets)
    zero = F.lit(0).cast("decimal(18,4)")
    return bucketed.withColumns({
        "is_core": core,
        "amount_confirmed": F.when(in_set(F.lower("payment_state"), rules.paid_states), F.col("amount_expected")).otherwise(zero),
        "cost": F.when(core, F.col("cost")).otherwise(zero),
    })
