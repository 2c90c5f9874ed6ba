"""Win rates by segment, on all deals or on the held-meeting cohort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlens.functions.metrics import MONEY, avg_if, lift_ratio, money_avg, pctl, rate
from bizlens.operators.aggregate import segment_rates
from bizlens.operators.joins import cohort


def win_rate(deals: DataFrame, company: DataFrame, dims: Sequence[str]) -> DataFrame:
    """All deals by company attributes, with the mean MRR of won deals."""
    g = deals.join(company, "company_key").groupBy(*dims).agg(
        F.count(F.lit(1)).alias("total_deals"), F.sum("is_won").alias("won"), F.sum("is_lost").alias("lost"),
        F.round(money_avg("mrr_usd", F.col("is_won") == 1), 2).alias("avg_won_mrr_usd"))
    return g.withColumn("win_rate_pct", rate("won", "total_deals"))


def held(deals: DataFrame, meetings: DataFrame) -> DataFrame:
    """Deals with a held meeting."""
    return cohort(deals, meetings, "deal_key", F.col("meeting_status") == "Held")


def held_win_rate(deals: DataFrame, meetings: DataFrame, company: DataFrame, dims: Sequence[str]) -> DataFrame:
    return segment_rates(held(deals, meetings).join(company, "company_key"), dims, "is_won", n="held_deals")


def combined(cohort_deals: DataFrame, company: DataFrame, dim: str, values: Sequence[str]) -> DataFrame:
    """Wins and rate of several segment values taken together."""
    inside = cohort_deals.join(company.filter(F.col(dim).isin(list(values))), "company_key")
    g = inside.agg(F.count(F.lit(1)).alias("held_deals"), F.coalesce(F.sum("is_won"), F.lit(0)).alias("won"))
    return g.withColumn("win_rate_pct", rate("won", "held_deals"))


def flat_control(deals: DataFrame, company: DataFrame, dim: str) -> DataFrame:
    """Spread of the win rate over a control attribute; a small spread means no signal."""
    g = segment_rates(deals.join(company, "company_key"), [dim], "is_won")
    return g.agg(
        F.count(F.lit(1)).alias("segments"), F.min("win_rate_pct").alias("min_rate_pct"),
        F.max("win_rate_pct").alias("max_rate_pct"),
        F.round(F.max("win_rate_pct") - F.min("win_rate_pct"), 2).alias("spread_pts"))


def heatmap(deals: DataFrame, company: DataFrame, row: str = "industry", column: str = "employee_band") -> DataFrame:
    return segment_rates(deals.join(company, "company_key"), [row, column], "is_won", n="deals", digits=1)


def lift(cohort_deals: DataFrame, company: DataFrame, dim: str, value: str) -> DataFrame:
    """One segment against the rest and against everybody, in one aggregation."""
    df = cohort_deals.join(company, "company_key")
    inside: Column = F.col(dim) == value
    g = df.agg(
        avg_if("is_won", inside).alias("segment_rate"), avg_if("is_won", ~inside).alias("rest_rate"),
        F.avg("is_won").alias("baseline_rate"), F.count_if(inside).alias("segment_n"))
    return g.select(
        "segment_n", F.round("segment_rate", 6).alias("segment_rate"), F.round("rest_rate", 6).alias("rest_rate"),
        F.round("baseline_rate", 6).alias("baseline_rate"),
        F.round(F.col("segment_rate") - F.col("baseline_rate"), 6).alias("lift_points"),
        F.round(lift_ratio(F.col("segment_rate"), F.col("rest_rate")), 4).alias("lift_vs_rest"))


def spread(df: DataFrame, key: str, flag: str = "is_won") -> DataFrame:
    """Best, second, median and worst member by rate, and the best/worst ratio.

    Two stages: rates per member, then one small aggregate of those rates (the two best come from
    a bounded top-2, ties by key).
    """
    rates = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(flag).alias("rate"))
    two = rates.orderBy(F.col("rate").desc(), F.col(key)).limit(2).agg(F.collect_list(F.struct("rate", F.col(key).alias("key"))).alias("two"))
    ordered = F.array_sort("two", lambda a, b: F.when(a["rate"] > b["rate"], -1).when(a["rate"] < b["rate"], 1).when(a["key"] < b["key"], -1).otherwise(1))
    best = two.withColumn("two", ordered).select(F.try_element_at("two", F.lit(1)).alias("a"), F.try_element_at("two", F.lit(-1)).alias("b")).select(
        F.col("a.rate").alias("top"), F.col("b.rate").alias("second"), F.col("a.key").alias("top_key"))
    rest = rates.agg(F.count(F.lit(1)).alias("members"), pctl(F.round("rate", 6), 0.5).alias("median"), F.min("rate").alias("bottom"))
    joined = best.unionByName(rest, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in ["members", "top_key", "top", "second", "median", "bottom"]])
    return joined.select(
        "members", "top_key", F.round("top", 4).alias("top_rate"), F.round("second", 4).alias("second_rate"),
        F.round("median", 4).alias("median_rate"), F.round("bottom", 4).alias("bottom_rate"),
        F.round(lift_ratio(F.col("top"), F.greatest("bottom", F.lit(1e-9))), 2).alias("top_to_bottom"))


def positive_rate(df: DataFrame, dim: str, flag: str) -> DataFrame:
    return df.groupBy(dim).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(flag), 3).alias("positive_rate"))


def economics(deals: DataFrame) -> DataFrame:
    """Won MRR and mean MRR per won deal."""
    won = F.col("is_won") == 1
    return deals.agg(
        F.count_if(won).alias("won"), F.sum(F.when(won, F.col("mrr_usd").cast(MONEY))).cast("double").alias("won_mrr"),
        F.round(money_avg("mrr_usd", won), 2).alias("avg_mrr"))
