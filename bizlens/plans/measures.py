"""Measure registry: named measures over a star, evaluated under a filter and a grouping.

A measure is built from leaves, each an additive aggregate of one fact, so any measure can be cut by any
attribute its facts reach. Facts are aggregated separately and only meet afterwards, which keeps
cross-fact ratios free of fan-out.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlens.functions.metrics import MONEY, ratio
from bizlens.operators.ordering import same


@dataclass(frozen=True)
class Star:
    """Facts, dimensions and the key by which each fact reaches a dimension.

    Facts are given as functions, so only those that a measure touches are planned.
    """

    facts: Mapping[str, Callable[[], DataFrame]]
    dims: Mapping[str, DataFrame]
    paths: Mapping[tuple[str, str], str]


@dataclass(frozen=True)
class Leaf:
    """An additive aggregate of one fact.

    ``needs`` names the columns its expression reads from dimensions. ``removes`` names columns whose filter and grouping do not
    reach the leaf: a total over them, or a fixed condition on them that stands in their place.
    """

    fact: str
    expr: Callable[[], Column]
    needs: tuple[str, ...] = ()
    removes: tuple[str, ...] = ()


@dataclass(frozen=True)
class Measure:
    """``formula`` combines the leaf values.

    A leaf without rows reads as 0 in totals and differences. With ``keep_blank`` it stays NULL, so a
    ratio of nothing is blank rather than 0.
    """

    leaves: Mapping[str, Leaf]
    formula: Callable[[Mapping[str, Column]], Column]
    keep_blank: bool = False


def _money(c: str, cond: Callable[[], Column] | None = None) -> Callable[[], Column]:
    def build() -> Column:
        v = F.col(c).cast("decimal(18,4)" if c in ("amount_expected", "amount_confirmed", "cost") else MONEY)
        return F.sum(F.when(cond(), v) if cond else v).cast("double")
    return build


def _sum(c: str, cond: Callable[[], Column] | None = None) -> Callable[[], Column]:
    return lambda: F.sum(F.when(cond(), F.col(c)) if cond else F.col(c)).cast("double")


def _count(cond: Callable[[], Column] | None = None) -> Callable[[], Column]:
    return lambda: (F.count_if(cond()) if cond else F.count(F.lit(1))).cast("double")


def _held() -> Column:
    return F.col("meeting_status") == "Held"


def _won() -> Column:
    return F.col("is_won") == 1


CALLS = Leaf("calls", _count())
CONNECTED = Leaf("calls", _sum("is_connected"))
BOOKED = Leaf("calls", _sum("is_meeting_booked"))
MEETINGS = Leaf("meetings", _count())
HELD = Leaf("meetings", _count(_held))
CANCELLED = Leaf("meetings", _count(lambda: F.col("meeting_status") == "Cancelled"))
DEALS = Leaf("deals", _count())
WON = Leaf("deals", _sum("is_won"))
LOST = Leaf("deals", _sum("is_lost"))
WON_MRR = Leaf("deals", _money("mrr_usd", _won))
CHURNED = Leaf("deals", _sum("is_churned", _won))
CHURNED_MRR = Leaf("deals", _money("churned_mrr", _won))
HOURS = Leaf("deals", _sum("dialer_hours"))


def _one(name: str, leaf: Leaf) -> Measure:
    return Measure({name: leaf}, lambda v: v[name])


def _ratio(num: Leaf, den: Leaf) -> Measure:
    return Measure({"num": num, "den": den}, lambda v: ratio(v["num"], v["den"]), keep_blank=True)


def _mean(fact: str, c: str, cond: Callable[[], Column]) -> Measure:
    """Mean of a column over the rows that satisfy a condition and carry a value."""
    return _ratio(Leaf(fact, _sum(c, cond)), Leaf(fact, _count(lambda: cond() & F.col(c).isNotNull())))


def _always() -> Column:
    return F.lit(True)


def _share(leaf: Leaf, over: tuple[str, ...]) -> Measure:
    """The leaf over its own total without any filter or grouping on the columns of ``over``."""
    return Measure({"part": leaf, "whole": replace(leaf, removes=over)}, lambda v: ratio(F.coalesce(v["part"], F.lit(0.0)), v["whole"]), keep_blank=True)


def selected_flag(column: str, values: Sequence[str], fact: str = "deals") -> Measure:
    """1 when the context holds exactly one value of ``column`` and it is listed, else 0."""
    lo = Leaf(fact, lambda: F.min(column), (column,))
    hi = Leaf(fact, lambda: F.max(column), (column,))
    return Measure({"lo": lo, "hi": hi}, lambda v: F.coalesce(((v["lo"] == v["hi"]) & v["lo"].isin(list(values))).cast("double"), F.lit(0.0)), keep_blank=True)


def standard_measures(cancel_reason: str, anti_segments: Sequence[str], sweet_spot: str, trap_channel: str) -> dict[str, Measure]:
    """The sales measures; the segment names they depend on are arguments."""
    def cancelled_loss() -> Column:
        return (F.col("is_lost") == 1) & (F.col("lost_reason") == cancel_reason)

    def sweet() -> Column:
        return F.col("employee_band") == sweet_spot

    return {
        "total_calls": _one("v", CALLS),
        "connected_calls": _one("v", CONNECTED),
        "connect_rate": _ratio(CONNECTED, CALLS),
        "meetings_booked": _one("v", BOOKED),
        "meetings_held": _one("v", HELD),
        "meeting_show_rate": _ratio(HELD, BOOKED),
        "won_deals": _one("v", WON),
        "lost_deals": _one("v", LOST),
        "win_rate_meeting": _ratio(WON, HELD),
        "win_rate_call": _ratio(WON, CALLS),
        "cancellation_share_of_losses": _ratio(Leaf("deals", _count(cancelled_loss), ("lost_reason",), ("lost_reason",)), LOST),
        "mrr_won": _one("v", WON_MRR),
        "avg_mrr_per_won_deal": _ratio(WON_MRR, WON),
        "avg_days_call_to_meeting": _mean("meetings", "days_from_create", _held),
        "avg_days_meeting_to_won": _mean("meetings", "days_to_close", _won),
        "anti_icp_flag": selected_flag("industry", anti_segments),
        "sweet_spot_lift": Measure(
            {"w": WON, "h": HELD, "sw": Leaf("deals", lambda: F.sum(F.when(sweet(), F.col("is_won"))).cast("double"), ("employee_band",), ("employee_band",)),
             "sh": Leaf("meetings", _count(lambda: _held() & sweet()), ("employee_band",), ("employee_band",))},
            lambda v: ratio(v["sw"], v["sh"]) - ratio(v["w"], v["h"])),
        "deals": _one("v", DEALS),
        "win_rate": _ratio(WON, DEALS),
        "volume_share": _share(DEALS, ("channel_name", "channel_group")),
        "meeting_cancel_rate": _ratio(CANCELLED, MEETINGS),
        "won_mrr_share": _share(WON_MRR, ("channel_name", "channel_group")),
        "dialer_hours": _one("v", HOURS),
        "mrr_per_dialer_hour": _ratio(WON_MRR, HOURS),
        "avg_days_to_won": _mean("deals", "deal_age_days", _won),
        "rebooking_trap_flag": selected_flag("channel_name", [trap_channel]),
        "churned_deals": _one("v", CHURNED),
        "retention_rate": Measure({"c": CHURNED, "w": WON}, lambda v: F.lit(1.0) - ratio(v["c"], v["w"])),
        "churned_mrr": _one("v", CHURNED_MRR),
        "net_revenue_retention": Measure({"m": WON_MRR, "c": CHURNED_MRR}, lambda v: ratio(v["m"] - v["c"], v["m"])),
        "won_and_retained": Measure({"w": WON, "c": CHURNED}, lambda v: v["w"] - v["c"]),
    }


def domain_measures(uplift: float = 0.1, threshold: float = 0.5, top: float | None = None) -> dict[str, Measure]:
    """Measures of the scoring, signal, planning and finance facts.

    ``uplift`` raises the expected sales of the what-if need, ``threshold`` is what counts as a high score, and
    ``top`` the score at the edge of the top tenth (``at_or_above_fraction``) that the top-decile lift needs.
    """
    def high() -> Column:
        return F.col("score") >= threshold

    def exact() -> Column:
        return F.col("score").cast("decimal(20,12)")

    found = {
        "high_score_leads": _one("v", Leaf("scores", _count(high))),
        "avg_predicted_probability": _ratio(Leaf("scores", lambda: F.sum(exact()).cast("double")), Leaf("scores", _count())),
        "precision_at_threshold": _ratio(Leaf("scores", _count(lambda: high() & (F.col("label") == 1))), Leaf("scores", _count(high))),
        "avg_signals_per_record": _ratio(Leaf("signals", _sum("n_signals")), Leaf("signals", _count())),
        "signal_coverage": _ratio(Leaf("signals", _count(lambda: F.col("covered"))), Leaf("signals", _count())),
        "avg_intent_score": _ratio(Leaf("signals", _sum("intent_score")), Leaf("signals", _count())),
        "total_to_produce": _one("v", Leaf("plan", lambda: F.sum(F.col("production_need").cast("decimal(18,4)")).cast("double"))),
        "what_if_need": _one("v", Leaf("plan", lambda: F.sum((F.col("expected_sales") * (1 + uplift) - F.col("stock_on_hand") - F.col("incoming")).cast("decimal(18,4)")).cast("double"))),
        "varieties_red": _one("v", Leaf("plan", _count(lambda: F.col("status") == "red"))),
        "needing_production": _one("v", Leaf("plan", _count(lambda: F.col("production_need") > 0))),
        "revenue": _one("v", Leaf("lines", _money("amount_expected"))),
        "revenue_confirmed": _one("v", Leaf("lines", _money("amount_confirmed"))),
        "revenue_recognized": _one("v", Leaf("recognized", _money("amount_expected"))),
        "cogs": _one("v", Leaf("lines", _money("cost"))),
        "contribution": Measure({"r": Leaf("lines", _money("amount_expected")), "c": Leaf("lines", _money("cost"))}, lambda v: F.round(v["r"] - v["c"], 4)),
        "outstanding": Measure({"r": Leaf("lines", _money("amount_expected")), "p": Leaf("lines", _money("amount_confirmed"))}, lambda v: F.round(v["r"] - v["p"], 4)),
        "core_gross_margin": Measure(
            {"r": Leaf("lines", _money("amount_expected", lambda: F.col("is_core"))), "c": Leaf("lines", _money("cost", lambda: F.col("is_core")))},
            lambda v: ratio(v["r"] - v["c"], v["r"])),
    }
    if top is not None:
        best = lambda: F.col("score") >= top
        found["top_decile_lift"] = Measure(
            {"s": Leaf("scores", lambda: F.sum(F.when(best(), exact())).cast("double")), "n": Leaf("scores", _count(best)),
             "all": Leaf("scores", lambda: F.sum(exact()).cast("double")), "rows": Leaf("scores", _count())},
            lambda v: F.try_divide(ratio(v["s"], v["n"]), ratio(v["all"], v["rows"])), keep_blank=True)
    return found


DOMAIN_MEASURES = domain_measures()


def _reach(star: Star, fact: str, columns: Sequence[str]) -> DataFrame:
    """The fact joined to just the dimensions that hold the asked columns."""
    df = star.facts[fact]()
    have = set(df.columns)
    for name, dim in star.dims.items():
        wanted = [c for c in columns if c in dim.columns and c not in have]
        if not wanted or (fact, name) not in star.paths:
            continue
        key = star.paths[fact, name]
        df = df.join(dim.select(key, *[c for c in wanted if c != key]), key)
        have.update(wanted)
    missing = [c for c in columns if c not in have]
    if missing:
        raise ValueError(f"fact {fact!r} cannot be cut by {missing}")
    return df


def evaluate(star: Star, registry: Mapping[str, Measure], names: Sequence[str], by: Sequence[str] = (),
             where: Mapping[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Several measures under one grouping and filter; ``where`` maps a column to its condition.

    Each fact is aggregated once per set of removed columns, and a leaf that several measures share is computed once.
    Leaves that remove columns are evaluated without the conditions and the grouping on these, and then meet
    the rows they hold for (a result without a row of the remaining groups has none).
    """
    by, where = list(by), dict(where or {})
    columns: dict[Leaf, str] = {}
    for name in names:
        for leaf in registry[name].leaves.values():
            columns.setdefault(leaf, f"_leaf{len(columns)}")
    by_removed: dict[tuple[str, ...], dict[str, dict[str, Leaf]]] = {}
    for leaf, column in columns.items():
        felt = tuple(sorted(c for c in leaf.removes if c in by or c in where))
        by_removed.setdefault(felt, {}).setdefault(leaf.fact, {})[column] = leaf

    def grouped(facts: Mapping[str, Mapping[str, Leaf]], removed: Sequence[str]) -> DataFrame:
        keys, conditions = [c for c in by if c not in removed], {c: f for c, f in where.items() if c not in removed}
        frames = []
        for fact, leaves in facts.items():
            needed = list(dict.fromkeys([*keys, *conditions, *[c for leaf in leaves.values() for c in leaf.needs]]))
            df = _reach(star, fact, needed)
            for c, condition in conditions.items():
                df = df.filter(condition(F.col(c)))
            aggs = [leaf.expr().alias(n) for n, leaf in leaves.items()]
            frames.append(df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs))
        if len(frames) == 1:
            return frames[0]
        stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
        folded = [F.max(c).alias(c) for leaves in facts.values() for c in leaves]
        return stacked.groupBy(*keys).agg(*folded) if keys else stacked.agg(*folded)

    if () not in by_removed:  # the rows of the result come from the groups that the facts of the first measure have
        first = next(iter(columns))
        by_removed[()] = {first.fact: {"_rows": Leaf(first.fact, lambda: F.count(F.lit(1)))}}
    g = grouped(by_removed.pop(()), ())
    for removed, facts in by_removed.items():
        total, own = grouped(facts, removed), [c for leaves in facts.values() for c in leaves]
        keys = [c for c in by if c not in removed]
        if keys:
            total = total.select(*[F.col(c).alias(f"_key_{c}") for c in keys], *own)
            g = g.join(total, same([F.col(c) for c in keys], [F.col(f"_key_{c}") for c in keys]), "left").drop(*[f"_key_{c}" for c in keys])
        else:
            one = total.select(F.struct(*own)).scalar()
            g = g.withColumns({c: one[c] for c in own})

    def values(measure: Measure) -> dict[str, Column]:
        found = {n: F.col(columns[leaf]) for n, leaf in measure.leaves.items()}
        return found if measure.keep_blank else {n: F.coalesce(c, F.lit(0.0)) for n, c in found.items()}

    return g.select(*by, *[registry[name].formula(values(registry[name])).alias(name) for name in names])


def guard(registry: Mapping[str, Measure], required: Sequence[str]) -> list[str]:
    """Required measures the registry lacks."""
    return [n for n in required if n not in registry]
