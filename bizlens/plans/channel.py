"""Channel performance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlens.functions.bands import recode
from bizlens.functions.metrics import MONEY, count_if, pctl, ratio, rate, remainder_rate
from bizlens.operators.aggregate import collapse_to_grain, segment_rates
from bizlens.operators.ordering import share, shares


def _won() -> Column:
    return F.col("is_won") == 1


def _mrr(c: str = "mrr_usd", where: Column | None = None) -> Column:
    v = F.col(c).cast(MONEY)
    return F.sum(v if where is None else F.when(where, v)).cast("double")


def scorecard(deals: DataFrame, dim_channel: DataFrame) -> DataFrame:
    """Win rate, volume share, median days to won, won MRR and MRR per dialer hour."""
    g = deals.join(dim_channel, "channel_key").groupBy("channel_name", "channel_group").agg(
        F.count(F.lit(1)).alias("deals"), F.sum("is_won").alias("won"),
        pctl("deal_age_days", 0.5, _won()).alias("t2w_median_days"),
        _mrr().alias("won_mrr"), F.sum("dialer_hours").alias("_hours"))
    g = g.withColumns({
        "win_rate_pct": rate("won", "deals", digits=1),
        "mrr_per_dialer_hr": F.round(ratio("won_mrr", "_hours"), 0),
    })
    return share(g, "deals", "vol_share_pct").drop("_hours")


def group_rollup(deals: DataFrame, dim_channel: DataFrame) -> DataFrame:
    g = deals.join(dim_channel, "channel_key").groupBy("channel_group").agg(
        F.count(F.lit(1)).alias("deals"), F.sum("is_won").alias("won"), _mrr().alias("won_mrr"))
    return share(g.withColumn("win_rate_pct", rate("won", "deals", digits=1)), "won_mrr", "won_mrr_share_pct")


def economics(deals: DataFrame, dim_channel: DataFrame) -> DataFrame:
    """Win rate, 12-month retention, net MRR and net revenue retention per channel."""
    g = deals.join(dim_channel, "channel_key").groupBy("channel_name", "channel_group").agg(
        F.count(F.lit(1)).alias("deals"), F.sum("is_won").alias("won_deals"), F.sum("is_churned").alias("_churned"),
        _mrr(where=_won()).alias("won_mrr"), F.sum(F.when(_won(), F.col("mrr_usd").cast(MONEY) - F.col("churned_mrr").cast(MONEY))).cast("double").alias("net_won_mrr"),
        F.sum("dialer_hours").alias("dialer_hours"))
    return g.withColumns({
        "win_rate_pct": rate("won_deals", "deals", digits=1),
        "m12_retention_pct": remainder_rate("_churned", "won_deals"),
        "nrr_pct": rate("net_won_mrr", "won_mrr", digits=1),
    }).drop("_churned")


def trap(deals: DataFrame, meetings: DataFrame, dim_channel: DataFrame, channel: str) -> DataFrame:
    """One channel's win rate against its cancel rate and the hours it burns."""
    of_channel = dim_channel.filter(F.col("channel_name") == channel)
    picked = deals.join(of_channel, "channel_key")
    flags = collapse_to_grain(
        meetings.select("deal_key", "meeting_status"), "deal_key",
        [F.max((F.col("meeting_status") == "Cancelled").cast("int")).alias("any_cancelled")])
    g = picked.join(flags, "deal_key").groupBy("channel_name").agg(
        F.count(F.lit(1)).alias("deals"), F.sum("is_won").alias("won"), F.sum("any_cancelled").alias("cancelled"),
        F.sum("dialer_hours").alias("dialer_hours"), _mrr().alias("won_mrr"))
    return g.withColumns({"win_rate_pct": rate("won", "deals", digits=1), "cancel_rate_pct": rate("cancelled", "deals", digits=1)})


def matrix(deals: DataFrame, dim_channel: DataFrame, company: DataFrame, min_n: int = 20) -> DataFrame:
    """Win rate per channel and employee band, cells below ``min_n`` deals left out."""
    base = deals.select("channel_key", "company_key", "is_won").join(
        company.select("company_key", "employee_band"), "company_key").join(dim_channel, "channel_key")
    return segment_rates(base, ["channel_name", "employee_band"], "is_won", n="deals", digits=1, min_n=min_n)


def motion_split(deals: DataFrame, dim_channel: DataFrame, expansion: Sequence[str] = ("Expansion",)) -> DataFrame:
    motion = recode("channel_group", {"Expansion": expansion}, "New acquisition").alias("motion")
    g = deals.join(dim_channel, "channel_key").groupBy(motion).agg(
        F.count(F.lit(1)).alias("deals"), F.sum("is_won").alias("won"), _mrr().alias("won_mrr"))
    return g.withColumn("win_rate_pct", rate("won", "deals", digits=1))


def band_rollup(deals: DataFrame, dim_channel: DataFrame, bands: Mapping[str, Sequence[str]]) -> DataFrame:
    """Shares of deals, MRR, net MRR and dialer hours per allocation band."""
    g = deals.join(dim_channel, "channel_key").groupBy(recode("channel_name", bands).alias("band")).agg(
        F.count(F.lit(1)).alias("deals"), _mrr().alias("mrr"),
        F.sum(F.col("mrr_usd").cast(MONEY) - F.col("churned_mrr").cast(MONEY)).cast("double").alias("net"),
        F.sum("is_won").alias("won"), F.sum("is_churned").alias("churned"), F.sum("dialer_hours").alias("hours"))
    g = g.withColumn("m12_retention_pct", remainder_rate("churned", "won"))
    out = shares(g, {"deal_share_pct": "deals", "won_mrr_share_pct": "mrr", "net_mrr_share_pct": "net", "dialer_hr_share_pct": "hours"})
    return out.select("band", "deals", "deal_share_pct", "won_mrr_share_pct", "m12_retention_pct", "net_mrr_share_pct", "dialer_hr_share_pct")


def resource_roi(deals: DataFrame, dim_channel: DataFrame) -> DataFrame:
    """What the dialer motion costs and returns, beside everything else."""
    dialer = F.col("is_dialer_motion") == 1
    g = deals.join(dim_channel, "channel_key").agg(
        F.count(F.lit(1)).alias("deals"), count_if(dialer).alias("dialer_deals"), F.sum(F.when(dialer, F.col("dialer_hours"))).alias("dialer_hours"),
        _mrr(where=_won() & dialer).alias("dialer_mrr"), _mrr(where=_won() & ~dialer).alias("other_mrr"), _mrr(where=_won()).alias("won_mrr"))
    return g.select(
        "dialer_hours", "dialer_mrr", "other_mrr", F.round(ratio("dialer_mrr", "dialer_hours"), 2).alias("mrr_per_hour"),
        rate("dialer_deals", "deals").alias("dialer_deal_share_pct"), rate("dialer_mrr", "won_mrr").alias("dialer_mrr_share_pct"))


def touch_rollup(touches: DataFrame) -> DataFrame:
    """Touches, minutes and conversions per channel, and how many companies it reached first.

    The first touch per company is a ``min_by``, combined on the map side.
    """
    volume = touches.groupBy("channel_key").agg(
        F.count(F.lit(1)).alias("touches"), F.sum("minutes").cast("double").alias("minutes"),
        F.sum("led_to_deal").alias("conversions"))
    first = touches.groupBy("company_key").agg(F.min_by("channel_key", F.struct("touch_ts", "touch_key")).alias("channel_key"))
    firsts = first.groupBy("channel_key").agg(F.count(F.lit(1)).alias("first_touches"))
    return volume.join(firsts, "channel_key", "left").withColumns({
        "first_touches": F.coalesce("first_touches", F.lit(0)), "conversion_pct": rate("conversions", "touches")})
