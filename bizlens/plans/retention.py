"""What happens after the win."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlens.functions.bands import small_n_note
from bizlens.functions.metrics import MONEY, rate, remainder_rate

_SUMS = ("won_n", "churned_n", "won_mrr", "churned_mrr")


def _sums() -> list:
    return [
        F.count(F.lit(1)).alias("won_n"), F.sum("is_churned").alias("churned_n"),
        F.sum(F.col("mrr_usd").cast(MONEY)).cast("double").alias("won_mrr"),
        F.sum(F.col("churned_mrr").cast(MONEY)).cast("double").alias("churned_mrr"),
        F.sum(F.col("mrr_usd").cast(MONEY) - F.col("churned_mrr").cast(MONEY)).cast("double").alias("_net"),
    ]


def _rates(g: DataFrame) -> DataFrame:
    return g.withColumns({
        "m12_retention_pct": remainder_rate("churned_n", "won_n"), "nrr_pct": rate("_net", "won_mrr", digits=1)}).drop("_net")


def by_channel(deals: DataFrame, dim_channel: DataFrame, min_n: int = 50) -> DataFrame:
    won = deals.filter("is_won = 1").join(dim_channel, "channel_key")
    return _rates(won.groupBy("channel_name").agg(*_sums())).withColumn("read_note", small_n_note("won_n", min_n))


def blended(deals: DataFrame) -> DataFrame:
    return _rates(deals.filter("is_won = 1").agg(*_sums()))


def curve(deals: DataFrame, dim_channel: DataFrame, by: str = "channel_group", horizon: int = 12) -> DataFrame:
    """Share of won customers with ``retained_months >= m`` for every month up to the horizon.

    All months are counted in the one aggregation of the deals and unfolded afterwards, so
    deal rows are never multiplied.
    """
    won = deals.filter("is_won = 1").join(dim_channel, "channel_key")
    alive = [F.count_if(F.col("retained_months") >= m).alias(f"m{m}") for m in range(horizon + 1)]
    g = won.groupBy(by).agg(F.count(F.lit(1)).alias("won_n"), *alive)
    months = F.posexplode(F.array(*[F.col(f"m{m}") for m in range(horizon + 1)])).alias("month", "alive")
    return g.select(by, "won_n", months).withColumn("survival_pct", rate("alive", "won_n"))
