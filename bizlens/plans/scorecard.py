"""Additive, auditable scores. All weights, steps and cut-offs are data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlens.functions.bands import additive as additive_points
from bizlens.functions.bands import band_when, step_points
from bizlens.functions.metrics import MONEY, pctl, ratio
from bizlens.operators.ordering import shares

# Fixed values of the channel scorecard: (lower bound, points), and what is below every bound.
WIN_STEPS, WIN_ELSE = [(0.50, 50), (0.25, 30), (0.10, 12)], 4
NO_DIALER_POINTS, DIALER_STEPS, DIALER_ELSE = 30, [(15, 12)], -8
DAYS_STEPS, DAYS_ELSE = [(10, 8), (25, 3)], 0
RETENTION_STEPS, RETENTION_ELSE = [(0.80, 15), (0.60, 6)], 0
CHANNEL_CUTS, CHANNEL_BANDS = [60, 30, 12], ["Scale", "Maintain", "Cap", "Kill"]

# Fixed values of the lead scorecard.
LEAD_WEIGHTS: dict[str, tuple[Mapping[str, int], int]] = {
    "employee_band": ({"6-20": 50, "21-50": 12, "1-5": 3}, 0),
    "industry": ({"Consulting": -40, "Marketing": -40, "Transport": -40,
                  "Construction": 8, "Healthcare": 8, "Retail": 8, "Other Services": 8}, 5),
    "company_form": ({"Corporation": 3, "Partnership": 3}, 0),
}
CANCEL_STEPS, CANCEL_ELSE = [(2, -15), (1, 0)], 5
LEAD_CUTS, LEAD_BANDS = [50, 5], ["Dial", "Nurture", "Skip"]
ACTIONS = {"Dial": "call", "Nurture": "email", "Skip": "none"}


def channel(deals: DataFrame, dim_channel: DataFrame) -> DataFrame:
    """Four-factor channel score and its allocation band.

    A channel without wins has no cycle and no retention; both then score as their lowest step.
    """
    won = F.col("is_won") == 1
    g = deals.join(dim_channel, "channel_key").groupBy("channel_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum("is_won").alias("w"), F.sum("dialer_hours").alias("hours"),
        F.sum(F.when(won, F.col("mrr_usd").cast(MONEY))).cast("double").alias("mrr"),
        pctl("deal_age_days", 0.5, won).alias("days"), F.sum(F.when(won, F.col("is_churned"))).alias("churned"))
    dialer = F.when(F.col("hours") == 0, NO_DIALER_POINTS).otherwise(
        step_points(ratio("mrr", "hours"), DIALER_STEPS, DIALER_ELSE))
    kept = F.lit(1.0) - ratio("churned", "w")
    scored = g.select(
        "channel_name",
        step_points(ratio("w", "n"), WIN_STEPS, WIN_ELSE).alias("win_points"), dialer.alias("dialer_points"),
        step_points("days", DAYS_STEPS, DAYS_ELSE, at_most=True).alias("cycle_points"),
        step_points(kept, RETENTION_STEPS, RETENTION_ELSE).alias("retention_points"))
    total = F.col("win_points") + F.col("dialer_points") + F.col("cycle_points") + F.col("retention_points")
    return scored.withColumn("score", total).withColumn("band", band_when("score", CHANNEL_CUTS, CHANNEL_BANDS))


def lookup_points(feature: str, points: Mapping[str, int], otherwise: int) -> Column:
    """Points of a category; unlisted and NULL values score ``otherwise``."""
    table = F.create_map(*[F.lit(x) for kv in points.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.col(feature)), F.lit(otherwise))


def lead(company: DataFrame, prior_cancels: DataFrame | None, weights: Mapping[str, tuple[Mapping[str, int], int]] = LEAD_WEIGHTS,
         cuts: Sequence[int] = LEAD_CUTS, bands: Sequence[str] = LEAD_BANDS) -> DataFrame:
    """Lead score, band and action per company.

    ``prior_cancels`` has one row per company with a ``prior_cancels`` count; companies without a row have none.
    """
    df = company
    if prior_cancels is None:
        df = df.withColumn("prior_cancels", F.lit(0))
    else:
        df = df.join(prior_cancels.select("company_key", "prior_cancels"), "company_key", "left")
    cancels = F.coalesce(F.col("prior_cancels"), F.lit(0))
    score = step_points(cancels, CANCEL_STEPS, CANCEL_ELSE)
    for feature, (points, otherwise) in weights.items():
        score = score + lookup_points(feature, points, otherwise)
    band = band_when("score", list(cuts), list(bands))
    return df.withColumn("score", score.cast("int")).withColumn("band", band)


def coverage(scored: DataFrame, deals: DataFrame) -> DataFrame:
    """Share of companies and of past wins per band."""
    wins = deals.filter("is_won = 1").groupBy("company_key").agg(F.count(F.lit(1)).alias("wins"))
    g = scored.join(wins, "company_key", "left").groupBy("band").agg(
        F.count(F.lit(1)).alias("companies"), F.coalesce(F.sum("wins"), F.lit(0)).alias("wins"))
    return shares(g, {"universe_pct": "companies", "wins_pct": "wins"})


def additive(df: DataFrame, points: Mapping[str, int | float], out: str = "score") -> DataFrame:
    """Generic additive score over 0/1 (or count) columns."""
    return df.withColumn(out, additive_points(points))


@dataclass(frozen=True)
class Boost:
    """Extra points from a model probability."""

    points: int = 20
    threshold: float | None = 0.5


def boost(scored: DataFrame, prob: str, rule: Boost = Boost(), cuts: Sequence[int] = LEAD_CUTS, bands: Sequence[str] = LEAD_BANDS) -> DataFrame:
    """Add model points to the lead score: all of them above a threshold, or in proportion."""
    p = F.coalesce(F.col(prob), F.lit(0.0))
    if rule.threshold is None:
        extra = F.round(p * F.lit(rule.points), 0).cast("int")
    else:
        extra = F.when(p >= F.lit(rule.threshold), F.lit(rule.points)).otherwise(F.lit(0))
    out = scored.withColumn("boosted_score", F.col("score") + extra)
    return out.withColumn("boosted_band", band_when("boosted_score", list(cuts), list(bands)))


def before_after(boosted: DataFrame) -> DataFrame:
    """Companies per band before and after the boost."""
    both = F.array(F.struct(F.lit("before").alias("stage"), F.col("band").alias("band")),
                   F.struct(F.lit("after").alias("stage"), F.col("boosted_band").alias("band")))
    return boosted.select(F.inline(both)).groupBy("stage", "band").agg(F.count(F.lit(1)).alias("companies"))


def with_action(scored: DataFrame, actions: Mapping[str, str] = ACTIONS) -> DataFrame:
    table = F.create_map(*[F.lit(x) for kv in actions.items() for x in kv])
    return scored.withColumn("action", F.try_element_at(table, F.col("band")))


def route(scored: DataFrame, path: str) -> None:
    """Write the scored companies, one folder per action."""
    with_action(scored).hint("rebalance", "action").write.mode("overwrite").partitionBy("action").parquet(path)
