"""Why deals are lost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bizlens.functions.metrics import rate
from bizlens.operators import ordering
from bizlens.operators.ordering import share


def _lost(deals: DataFrame, dim_lost_reason: DataFrame) -> DataFrame:
    return deals.filter("is_lost = 1").join(dim_lost_reason, "lost_reason_key")


def pareto(deals: DataFrame, dim_lost_reason: DataFrame) -> DataFrame:
    """Lost deals per reason with share and cumulative share."""
    g = _lost(deals, dim_lost_reason).groupBy("lost_reason_key", "reason_category", "lost_reason").agg(
        F.count(F.lit(1)).alias("lost_deals"))
    run = ordering.pareto(g, "lost_reason_key", "lost_deals")
    return run.withColumnsRenamed({"share_pct": "pct_of_losses", "cum_share_pct": "cum_pct"})


def by_group(deals: DataFrame, dim_channel: DataFrame, dim_lost_reason: DataFrame) -> DataFrame:
    """Reason mix inside each channel group."""
    g = _lost(deals, dim_lost_reason).join(dim_channel, "channel_key").groupBy("channel_group", "reason_category").agg(
        F.count(F.lit(1)).alias("losses"))
    return share(g, "losses", "pct_of_group_losses", by=["channel_group"])


def mix(deals: DataFrame, dim_lost_reason: DataFrame) -> DataFrame:
    """Share of losses per category."""
    g = _lost(deals, dim_lost_reason).groupBy("reason_category").agg(F.count(F.lit(1)).alias("losses"))
    return share(g, "losses", "share_pct")


def reason_share(deals: DataFrame, dim_lost_reason: DataFrame, reason: str) -> DataFrame:
    """Losses with one reason over all losses."""
    flagged = deals.filter("is_lost = 1").join(dim_lost_reason, "lost_reason_key", "left")
    return flagged.agg(F.count_if(F.col("lost_reason") == reason).alias("with_reason"), F.count(F.lit(1)).alias("lost")).withColumn(
        "share_pct", rate("with_reason", "lost"))


def rank_in_group(losses: DataFrame) -> DataFrame:
    """Order of the reasons inside each group."""
    w = Window.partitionBy("channel_group").orderBy(F.col("losses").desc(), "reason_category")
    return losses.withColumn("rank", F.row_number().over(w))
