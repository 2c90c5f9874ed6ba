"""Monthly cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlens.functions.dates import date_key
from bizlens.functions.metrics import MONEY
from bizlens.operators.joins import join_date


def monthly_won(deals: DataFrame, dim_date: DataFrame) -> DataFrame:
    """Won deals per calendar month of the won date.

    Deals are summed per day first, so the calendar join sees one row per day, not per deal.
    """
    won = deals.filter((F.col("is_won") == 1) & F.col("deal_age_days").isNotNull())
    day = won.withColumn("won_date_key", date_key(F.date_add("created_date", F.col("deal_age_days"))))
    daily = day.groupBy("won_date_key").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("mrr_usd").cast(MONEY)).alias("mrr"), F.sum("deal_age_days").alias("age"))
    cal = dim_date.select("date_key", "year", "month", "month_name")
    g = join_date(daily, cal, "won_date_key").groupBy("year", "month", "month_name")
    return g.agg(
        F.sum("n").alias("won_deals"), F.round(F.sum("mrr").cast("double"), 0).alias("won_mrr_usd"),
        F.round(F.sum("age").cast("double") / F.sum("n").cast("double"), 1).alias("avg_cycle_days"))
