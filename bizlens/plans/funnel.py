"""Outreach funnel: steps, conversion, representatives, drop-off."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlens.functions.metrics import MONEY, any_flag, rate
from bizlens.operators.aggregate import drill_across, one_row, unpivot_row

STEPS = ["Calls Attempted", "Calls Connected", "Meetings Booked", "Meetings Held", "Deals Won"]


def totals(calls: DataFrame, meetings: DataFrame, deals: DataFrame) -> DataFrame:
    """The five step counts in one row: one pass per fact."""
    return one_row([
        (calls, {"calls": F.count(F.lit(1)), "connected": F.sum("is_connected").cast("bigint"),
                 "booked": F.sum("is_meeting_booked").cast("bigint")}),
        (meetings, {"held": F.count_if(F.col("meeting_status") == "Held")}),
        (deals, {"won": F.sum("is_won").cast("bigint")}),
    ])


def waterfall(calls: DataFrame, meetings: DataFrame, deals: DataFrame) -> DataFrame:
    row = totals(calls, meetings, deals).withColumnsRenamed(
        dict(zip(["calls", "connected", "booked", "held", "won"], STEPS)))
    steps = unpivot_row(row, STEPS, "funnel_step", "records")
    order = F.array_position(F.array(*[F.lit(s) for s in STEPS]), F.col("funnel_step")).cast("int")
    return steps.select(order.alias("step_order"), "funnel_step", F.coalesce("records", F.lit(0)).alias("records"))


def step_rates(calls: DataFrame, meetings: DataFrame, deals: DataFrame) -> DataFrame:
    return totals(calls, meetings, deals).select(
        rate("connected", "calls").alias("connect_rate_pct"),
        rate("booked", "connected").alias("meeting_book_rate_pct"),
        rate("held", "booked").alias("meeting_show_rate_pct"),
        rate("won", "held").alias("won_from_meeting_pct"),
        rate("won", "calls").alias("overall_win_rate_pct"),
    )


def rep_leaderboard(rep: DataFrame, calls: DataFrame, deals: DataFrame, min_calls: int = 50) -> DataFrame:
    """Calls and won deals per representative; each fact is aggregated before it meets the dimension."""
    board = drill_across(rep, {
        "calls": (calls, [F.count(F.lit(1)).alias("total_calls"), F.sum("is_connected").alias("connected_calls"),
                          F.sum("is_meeting_booked").alias("meetings_booked")]),
        "deals": (deals, [F.sum("is_won").alias("deals_won"),
                          F.sum(F.when(F.col("is_won") == 1, F.col("mrr_usd").cast(MONEY))).alias("won_mrr")]),
    }, "rep_key")
    return board.filter(F.col("total_calls") >= min_calls).select(
        "rep_key", "rep_name", "rep_team", "total_calls", "connected_calls", "meetings_booked",
        F.coalesce("deals_won", F.lit(0)).alias("deals_won"),
        F.coalesce(F.round(F.col("won_mrr").cast("double"), 0), F.lit(0.0)).alias("won_mrr_usd"),
        rate("meetings_booked", "total_calls").alias("meeting_rate_pct"),
    )


def dropoff_by_source(deals: DataFrame, dim_source: DataFrame, dim_stage: DataFrame, from_stage: int = 3) -> DataFrame:
    staged = deals.join(dim_source, "source_key").join(dim_stage, "stage_order")
    g = staged.groupBy("source_name").agg(
        F.count(F.lit(1)).alias("deals"),
        F.count_if(F.col("stage_order") >= from_stage).alias("reached_meeting"),
        F.sum("is_won").alias("won"),
        any_flag(F.col("is_won") == 1).alias("any_won"),
    )
    return g.withColumn("win_rate_pct", rate("won", "deals", digits=1))
