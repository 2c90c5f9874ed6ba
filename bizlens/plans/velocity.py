"""How long deals take."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlens.functions.metrics import avg_if, pctl
from bizlens.operators.aggregate import histogram


def summary(meetings: DataFrame) -> DataFrame:
    """Mean, median and p90 of both legs, from one pass over the meetings."""
    legs = {"days_call_to_meeting": "days_from_create", "days_meeting_to_close": "days_to_close"}
    stats = meetings.agg(*[
        F.struct(F.round(F.avg(c), 1).alias("avg_days"), pctl(c, 0.5).alias("median_days"),
                 F.round(pctl(c, 0.9), 4).alias("p90_days")).alias(name)
        for name, c in legs.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"{n}.avg_days"), F.col(f"{n}.median_days"), F.col(f"{n}.p90_days")) for n in legs])
    return stats.select(F.inline(rows))


def by_channel(deals: DataFrame, dim_channel: DataFrame) -> DataFrame:
    """Days-to-won quartiles of won deals per channel."""
    g = deals.filter("is_won = 1").join(dim_channel, "channel_key").groupBy("channel_name")
    return g.agg(
        F.count(F.lit(1)).alias("won_deals"),
        F.round(pctl("deal_age_days", 0.25), 4).alias("p25_days"),
        F.round(pctl("deal_age_days", 0.5), 4).alias("median_days"),
        F.round(pctl("deal_age_days", 0.9), 4).alias("p90_days"))


def split(meetings: DataFrame, deals: DataFrame, days: int = 30) -> DataFrame:
    """Close rate of held deals inside and outside ``days``."""
    held = meetings.filter("meeting_status = 'Held'").select("deal_key", "days_to_close").join(deals.select("deal_key", "is_won"), "deal_key")
    quick, slow = F.col("days_to_close") <= days, F.col("days_to_close") > days
    return held.agg(
        F.count_if(quick).alias("n_within"), F.round(avg_if("is_won", quick), 6).alias("rate_within"),
        F.count_if(slow).alias("n_beyond"), F.round(avg_if("is_won", slow), 6).alias("rate_beyond"))


def cycle_histogram(meetings: DataFrame, deals: DataFrame, bins: int = 30, longest: int = 3000) -> DataFrame:
    """Days to close of won deals, in equal bins."""
    won = meetings.join(deals.filter("is_won = 1").select("deal_key"), "deal_key", "left_semi")
    return histogram(won, "days_to_close", 0, longest, bins)
