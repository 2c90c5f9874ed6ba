"""The datasets behind the report pages: one measure by at most two columns per visual."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlens.plans.measures import Measure, Star, evaluate

# page -> visual -> (measure, grouping columns)
PAGES: dict[str, dict[str, tuple[str, tuple[str, ...]]]] = {
    "funnel": {
        "calls": ("total_calls", ()), "connect_rate": ("connect_rate", ()), "held": ("meetings_held", ()),
        "win_rate": ("win_rate_meeting", ()), "mrr": ("mrr_won", ()), "won_by_stage": ("won_deals", ("stage_name",)),
        "won_by_month": ("won_deals", ("month_name",)), "mrr_by_month": ("mrr_won", ("month_name",)),
    },
    "segments": {
        "by_band": ("win_rate_meeting", ("employee_band",)), "by_industry": ("win_rate_meeting", ("industry",)),
        "by_region": ("win_rate_meeting", ("region",)), "band_by_industry": ("win_rate_meeting", ("employee_band", "industry")),
    },
    "reps": {"by_rep": ("win_rate_meeting", ("rep_name",)), "calls_by_rep": ("total_calls", ("rep_name",))},
    "velocity": {
        "lost_by_category": ("lost_deals", ("reason_category",)), "won_by_days": ("won_deals", ("deal_age_days",)),
        "cancel_share": ("cancellation_share_of_losses", ()), "cycle": ("avg_days_meeting_to_won", ()), "avg_mrr": ("avg_mrr_per_won_deal", ()),
    },
    "overview": {
        "deals": ("deals", ()), "won": ("won_deals", ()), "win_rate": ("win_rate", ()), "mrr": ("mrr_won", ()), "avg_mrr": ("avg_mrr_per_won_deal", ()),
        "win_rate_by_channel": ("win_rate", ("channel_name",)), "mrr_by_channel": ("mrr_won", ("channel_name",)), "deals_by_channel": ("deals", ("channel_name",)),
    },
    "economics": {
        "nrr_by_channel": ("net_revenue_retention", ("channel_name",)), "retention_by_channel": ("retention_rate", ("channel_name",)),
        "win_rate_by_channel": ("win_rate", ("channel_name",)), "nrr_by_group": ("net_revenue_retention", ("channel_group",)),
        "dialer": ("mrr_per_dialer_hour", ()), "days_to_won": ("avg_days_to_won", ()),
    },
    "channel_segments": {
        "by_channel": ("win_rate", ("channel_name",)), "by_band": ("win_rate", ("employee_band",)), "by_industry": ("win_rate", ("industry",)),
        "channel_by_band": ("win_rate", ("channel_name", "employee_band")),
    },
    "retention_loss": {
        "retained_by_channel": ("won_and_retained", ("channel_name",)), "churned_mrr_by_channel": ("churned_mrr", ("channel_name",)),
        "lost_by_category": ("lost_deals", ("reason_category",)), "retention": ("retention_rate", ()), "nrr": ("net_revenue_retention", ()),
        "cancel_rate": ("meeting_cancel_rate", ()), "dialer": ("mrr_per_dialer_hour", ()),
    },
}


def datasets(star: Star, registry: Mapping[str, Measure], page: str) -> dict[str, DataFrame]:
    """One frame per visual."""
    return {visual: evaluate(star, registry, [m], by) for visual, (m, by) in PAGES[page].items()}


def dataset(star: Star, registry: Mapping[str, Measure], page: str) -> DataFrame:
    """All visuals of a page as ``(visual, category, legend, value)`` rows.

    Visuals with the same grouping share one evaluation, so a fact is read once per grouping.
    """
    groups: dict[tuple[str, ...], list[tuple[str, str]]] = {}
    for visual, (measure, by) in PAGES[page].items():
        groups.setdefault(by, []).append((visual, measure))
    frames = []
    for by, visuals in groups.items():
        g = evaluate(star, registry, sorted({m for _, m in visuals}), by)
        axes = [F.col(c).cast("string") for c in by] + [F.lit(None).cast("string")] * (2 - len(by))
        rows = F.array(*[F.struct(F.lit(v).alias("visual"), F.round(F.col(m), 6).alias("value")) for v, m in visuals])
        frames.append(g.select(axes[0].alias("category"), axes[1].alias("legend"), F.inline(rows)))
    return reduce(DataFrame.unionByName, frames).select("visual", "category", "legend", "value")
