"""Scorecards, measures, report pages and model metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from bizlens.operators.ordering import top_fraction
from bizlens.operators.quality import metric_rows, verify
from bizlens.plans import measures, ml, report, scorecard, signals
from bizlens.plans.measures import DOMAIN_MEASURES, Star, evaluate, standard_measures
from bizlens.registry.base_sql import big, dbl, pct, sql
from bizlens.registry.common import q
from bizlens.registry.money import _plan, plan_sql
from bizlens.sources.readers import inline_table
from bizlens.sources.warehouse import Warehouse

LEAD_WEIGHTS = {
    "employee_band": ({"6-20": 50, "21-50": 12, "1-5": 3}, 0),
    "industry": ({"FURNITURE": -40, "MACHINERY": -40, "AUTOMOBILE": 8, "BUILDING": 8}, 5),
    "region": ({"EUROPE": 3, "ASIA": 3}, 0),
}
POINTS = {"has_views": 10, "has_clicks": 8, "has_signups": 5, "has_purchases": 5, "has_errors": 8, "has_large_value": 6}
REGISTRY = {**standard_measures("Meeting cancelled", ["FURNITURE", "MACHINERY"], "6-20", "Urgent desk"), **DOMAIN_MEASURES}


def star(w: Warehouse) -> Star:
    def month(day: str):
        return F.date_format(day, "MMMM")

    def meetings():
        won = w.deals().select("deal_key", "is_won", month("created_date").alias("month_name"))
        return w.meetings().join(won, "deal_key")

    def entity_signals():
        total = sum((F.col(c) for c in POINTS), F.lit(0))
        return flags(w).withColumns({"n_signals": total, "covered": F.greatest("has_views", "has_clicks", "has_signups") == 1})

    facts = {
        "calls": lambda: w.calls().withColumn("month_name", month("call_date")),
        "meetings": meetings,
        "deals": lambda: w.deals_wide().withColumn("month_name", month("created_date")),
        "lines": lambda: w.lines().withColumn("month_name", month("invoice_date")),
        "recognized": lambda: w.lines().withColumn("month_name", month("recognition_date")),
        "scores": w.scored, "plan": lambda: _plan(w), "signals": entity_signals,
    }
    dims = {"company": w.company(), "rep": w.rep(), "channel": w.dim_channel(), "stage": w.dim_stage(), "lost_reason": w.dim_lost_reason()}
    paths = {
        ("calls", "company"): "company_key", ("calls", "rep"): "rep_key",
        ("meetings", "company"): "company_key", ("meetings", "rep"): "rep_key", ("meetings", "channel"): "channel_key",
        ("deals", "company"): "company_key", ("deals", "rep"): "rep_key", ("deals", "channel"): "channel_key",
        ("deals", "stage"): "stage_order", ("deals", "lost_reason"): "lost_reason_key",
    }
    return Star(facts, dims, paths)


def flags(w: Warehouse):
    return signals.intent_score(w.entity_flags(), POINTS)


def _measures(names: str, by: list[str], **kw):
    def run(w: Warehouse):
        out = evaluate(star(w), REGISTRY, names.split(), by, **kw)
        return out.withColumns({n: F.round(n, 6) for n in names.split()})
    return q(run)


def _leads(w: Warehouse):
    cancels = w.meetings().filter("meeting_status = 'Cancelled'").groupBy("company_key").agg(F.count(F.lit(1)).alias("n"))
    return scorecard.lead(w.company(), cancels.select("company_key", (F.col("n") - 8).alias("prior_cancels")), LEAD_WEIGHTS)


def _boosted(w: Warehouse):
    p = w.table("customer").select(F.col("c_custkey").alias("company_key"), ((F.col("c_custkey") * 37) % 1000 / 1000.0).alias("prob"))
    return scorecard.boost(_leads(w).join(p, "company_key"), "prob", scorecard.Boost(20, 0.5))


def _gbt(w: Warehouse):
    """Train on four fifths of the labelled documents, score the rest; few trees keep the check short."""
    d = w.scored().select("doc_id", F.col("label").cast("int").alias("quality"), "lang", "source", "n_chars")
    data = ml.stratified_split(ml.featurise(d, ids=("doc_id",), flags=(), label="quality", founded=None), "label", "doc_id")
    model = ml.train(data.filter("not is_test"), ["lang", "source"], ["n_chars"], trees=5, depth=3)
    scored = ml.score(model, data)
    train, test = ml.auc(scored.filter("not is_test"), "prob"), ml.auc(scored.filter("is_test"), "prob")
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


def _numbers(w: Warehouse):
    """Numbers registry: recompute the published figures and list those that do not hold (one of the three does)."""
    deals = w.deals()
    got = metric_rows({
        "deals": (deals, F.count(F.lit(1))), "won": (deals, F.sum("is_won")), "lost": (deals, F.sum("is_lost")),
        "won_mrr": (deals, F.sum("mrr_usd")), "lost_and_won": (deals, F.sum(F.col("is_won") * F.col("is_lost")))})
    published = inline_table(w.spark, [("deals", -1.0), ("lost_and_won", 0.0), ("not_computed", 3.0)], "metric string, value double")
    return verify(got, published)


LEAD_SQL = """, x AS (SELECT company_key, count(*) - 8 AS pc FROM meetings WHERE meeting_status = 'Cancelled' GROUP BY 1),
        lead AS (SELECT c.*, CASE WHEN coalesce(pc, 0) >= 2 THEN -15 WHEN coalesce(pc, 0) >= 1 THEN 0 ELSE 5 END
               + CASE employee_band WHEN '6-20' THEN 50 WHEN '21-50' THEN 12 WHEN '1-5' THEN 3 ELSE 0 END
               + CASE industry WHEN 'FURNITURE' THEN -40 WHEN 'MACHINERY' THEN -40 WHEN 'AUTOMOBILE' THEN 8 WHEN 'BUILDING' THEN 8 ELSE 5 END
               + CASE WHEN region IN ('EUROPE', 'ASIA') THEN 3 ELSE 0 END AS score FROM company c LEFT JOIN x ON x.company_key = c.company_key),
        banded AS (SELECT *, CASE WHEN score >= 50 THEN 'Dial' WHEN score >= 5 THEN 'Nurture' ELSE 'Skip' END AS band FROM lead)"""
SCORED_CURVE = """, c AS (SELECT score, sum(label) AS pos, count(*) - sum(label) AS neg FROM scored GROUP BY 1),
        r AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM c)"""
INTENT = " + ".join(f"{c} * {p}" for c, p in POINTS.items())
N_FLAGS = " + ".join(POINTS)


def _r6(expr: str) -> str:
    return f"round({expr}, 6)"


DEAL_MEASURES = {
    "deals": "CAST(count(*) AS DOUBLE)", "won_deals": dbl("sum(is_won)"), "lost_deals": dbl("sum(is_lost)"), "win_rate": "avg(is_won)",
    "mrr_won": f"coalesce({dbl('sum(mrr_usd) FILTER (WHERE is_won = 1)')}, 0)", "avg_mrr_per_won_deal": f"{dbl('sum(mrr_usd) FILTER (WHERE is_won = 1)')} / nullif(sum(is_won), 0)",
    "dialer_hours": "sum(dialer_hours)", "mrr_per_dialer_hour": f"{dbl('sum(mrr_usd) FILTER (WHERE is_won = 1)')} / nullif(sum(dialer_hours), 0)",
    "avg_days_to_won": "avg(deal_age_days) FILTER (WHERE is_won = 1)", "churned_deals": f"coalesce({dbl('sum(is_churned) FILTER (WHERE is_won = 1)')}, 0)",
    "retention_rate": f"1.0::DOUBLE - {dbl('sum(is_churned)')} / nullif({dbl('sum(is_won)')}, 0)", "churned_mrr": f"coalesce({dbl('sum(churned_mrr) FILTER (WHERE is_won = 1)')}, 0)",
    "net_revenue_retention": f"({dbl('sum(mrr_usd)')} - {dbl('sum(churned_mrr)')}) / nullif({dbl('sum(mrr_usd)')}, 0)", "won_and_retained": f"{dbl('sum(is_won)')} - {dbl('sum(is_churned)')}",
}
DEAL_LIST = ", ".join(f"{_r6(e)} AS {n}" for n, e in DEAL_MEASURES.items())
CROSS = "meetings_held win_rate_meeting meeting_show_rate win_rate_call connect_rate total_calls meetings_booked avg_days_call_to_meeting avg_days_meeting_to_won connected_calls"


def _cross_sql(by: str, keys: str) -> str:
    """Calls, meetings and deals each aggregated to the same keys, then joined."""
    return sql("calls meetings company", f"""
        , c AS (SELECT {by}, count(*) AS calls, sum(is_connected) AS con, sum(is_meeting_booked) AS booked FROM calls JOIN company USING (company_key) GROUP BY ALL),
        m AS (SELECT {by}, count(*) FILTER (WHERE meeting_status = 'Held') AS held, avg(days_from_create) FILTER (WHERE meeting_status = 'Held') AS d1,
                     avg(days_to_close) FILTER (WHERE is_won = 1) AS d2 FROM meetings JOIN company USING (company_key) JOIN (SELECT deal_key, is_won FROM deals) USING (deal_key) GROUP BY ALL),
        d AS (SELECT {by}, sum(is_won) AS won FROM deals JOIN company USING (company_key) GROUP BY ALL)
        SELECT {by}, CAST(held AS DOUBLE) AS meetings_held, {_r6('CAST(won AS DOUBLE) / nullif(held, 0)')} AS win_rate_meeting, {_r6('CAST(held AS DOUBLE) / nullif(booked, 0)')} AS meeting_show_rate,
               {_r6('CAST(won AS DOUBLE) / nullif(calls, 0)')} AS win_rate_call, {_r6('CAST(con AS DOUBLE) / nullif(calls, 0)')} AS connect_rate, CAST(coalesce(calls, 0) AS DOUBLE) AS total_calls,
               CAST(coalesce(booked, 0) AS DOUBLE) AS meetings_booked, {_r6('d1')} AS avg_days_call_to_meeting, {_r6('d2')} AS avg_days_meeting_to_won, CAST(coalesce(con, 0) AS DOUBLE) AS connected_calls
        FROM d LEFT JOIN m USING ({keys}) LEFT JOIN c USING ({keys})""".strip())


def _visual(name: str, value: str, source: str, category: str = "CAST(NULL AS VARCHAR)", legend: str = "CAST(NULL AS VARCHAR)") -> str:
    """One report visual as SQL rows, grouped by its axes."""
    group = "" if category.startswith("CAST(NULL") else " GROUP BY ALL"
    return f"SELECT '{name}' AS visual, {category} AS category, {legend} AS legend, round(CAST({value} AS DOUBLE), 6) AS value FROM {source}{group}"


WON_OVER_HELD = f"{dbl('sum(won)')} / nullif(sum(held), 0)"
RETAINED = f"1.0::DOUBLE - {dbl('sum(is_churned)')} / nullif(sum(is_won), 0)"
NRR = f"({dbl('sum(mrr_usd)')} - {dbl('sum(churned_mrr)')}) / nullif({dbl('sum(mrr_usd)')}, 0)"
PER_HOUR = f"{dbl('sum(mrr_usd)')} / nullif(sum(dialer_hours), 0)"
PAGE_SQL = {
    "funnel": sql("calls meetings dim_stage", """, d AS (SELECT *, monthname(created_date) AS mn FROM deals JOIN dim_stage USING (stage_order)),
        t AS (SELECT (SELECT sum(is_won) FROM deals) AS won, (SELECT count(*) FROM meetings WHERE meeting_status = 'Held') AS held) """ + " UNION ALL ".join([
        _visual("calls", "count(*)", "calls"), _visual("connect_rate", f"{dbl('sum(is_connected)')} / count(*)", "calls"), _visual("held", "sum(held)", "t"),
        _visual("win_rate", WON_OVER_HELD, "t"), _visual("mrr", "sum(mrr_usd)", "deals"), _visual("won_by_stage", "sum(is_won)", "d", "stage_name"),
        _visual("won_by_month", "sum(is_won)", "d", "mn"), _visual("mrr_by_month", "sum(mrr_usd)", "d", "mn")])),
    "segments": sql("meetings company", """, m AS (SELECT employee_band, industry, region, 1 AS held, 0 AS won FROM meetings JOIN company USING (company_key) WHERE meeting_status = 'Held'
        UNION ALL SELECT employee_band, industry, region, 0, is_won FROM deals JOIN company USING (company_key)) """ + " UNION ALL ".join([
        _visual("by_band", WON_OVER_HELD, "m", "employee_band"), _visual("by_industry", WON_OVER_HELD, "m", "industry"), _visual("by_region", WON_OVER_HELD, "m", "region"),
        _visual("band_by_industry", WON_OVER_HELD, "m", "employee_band", "industry")])),
    "reps": sql("deals_wide meetings calls rep", """, u AS (SELECT rep_key, 0 AS c, 0 AS held, is_won AS won FROM deals_wide
        UNION ALL SELECT rep_key, 0, CASE WHEN meeting_status = 'Held' THEN 1 ELSE 0 END, 0 FROM meetings UNION ALL SELECT rep_key, 1, 0, 0 FROM calls),
        g AS (SELECT * FROM u JOIN rep USING (rep_key)) """ + " UNION ALL ".join([
        _visual("by_rep", WON_OVER_HELD, "g", "rep_name"), _visual("calls_by_rep", "sum(c)", "g", "rep_name")])),
    "velocity": sql("deals_wide meetings dim_lost_reason", """, w AS (SELECT days_to_close FROM meetings JOIN deals USING (deal_key) WHERE is_won = 1) """ + " UNION ALL ".join([
        _visual("lost_by_category", "sum(is_lost)", "deals JOIN dim_lost_reason USING (lost_reason_key)", "reason_category"),
        _visual("won_by_days", "sum(is_won)", "deals_wide", "CAST(deal_age_days AS VARCHAR)"),
        _visual("cancel_share", f"{dbl('count(*) FILTER (WHERE is_lost = 1 AND lost_reason_key = 0)')} / sum(is_lost)", "deals"),
        _visual("cycle", "avg(days_to_close)", "w"), _visual("avg_mrr", f"{dbl('sum(mrr_usd)')} / sum(is_won)", "deals")])),
    "economics": sql("deals_wide dim_channel", """, d AS (SELECT * FROM deals_wide JOIN dim_channel USING (channel_key)) """ + " UNION ALL ".join([
        _visual("nrr_by_channel", NRR, "d", "channel_name"), _visual("retention_by_channel", RETAINED, "d", "channel_name"), _visual("win_rate_by_channel", "avg(is_won)", "d", "channel_name"),
        _visual("nrr_by_group", NRR, "d", "channel_group"), _visual("dialer", PER_HOUR, "d"), _visual("days_to_won", "avg(deal_age_days) FILTER (WHERE is_won = 1)", "d")])),
    "retention_loss": sql("deals_wide meetings dim_channel dim_lost_reason", """, d AS (SELECT * FROM deals_wide JOIN dim_channel USING (channel_key)) """ + " UNION ALL ".join([
        _visual("retained_by_channel", "sum(is_won) - sum(is_churned)", "d", "channel_name"), _visual("churned_mrr_by_channel", "sum(churned_mrr)", "d", "channel_name"),
        _visual("lost_by_category", "sum(is_lost)", "deals JOIN dim_lost_reason USING (lost_reason_key)", "reason_category"),
        _visual("retention", RETAINED, "d"), _visual("nrr", NRR, "d"), _visual("cancel_rate", "avg(CASE WHEN meeting_status = 'Cancelled' THEN 1 ELSE 0 END)", "meetings"), _visual("dialer", PER_HOUR, "d")])),
}

QUERIES = {
    # -- scorecards ---------------------------------------------------------------------------------
    "channel_score": (q(lambda w: scorecard.channel(w.deals_wide(), w.dim_channel())), sql("deals_wide dim_channel", f"""
        , g AS (SELECT channel_name, avg(is_won) AS wr, sum(dialer_hours) AS h, {dbl('sum(mrr_usd) FILTER (WHERE is_won = 1)')} AS m, quantile_cont(deal_age_days, 0.5) FILTER (WHERE is_won = 1) AS t,
                     1 - {dbl('sum(is_churned)')} / nullif({dbl('sum(is_won)')}, 0) AS rt FROM deals_wide JOIN dim_channel USING (channel_key) GROUP BY 1),
        p AS (SELECT channel_name, CASE WHEN wr >= 0.5 THEN 50 WHEN wr >= 0.25 THEN 30 WHEN wr >= 0.1 THEN 12 ELSE 4 END AS win_points,
                     CASE WHEN h = 0 THEN 30 WHEN m / h >= 15 THEN 12 ELSE -8 END AS dialer_points, CASE WHEN t <= 10 THEN 8 WHEN t <= 25 THEN 3 ELSE 0 END AS cycle_points,
                     CASE WHEN rt >= 0.8 THEN 15 WHEN rt >= 0.6 THEN 6 ELSE 0 END AS retention_points FROM g)
        SELECT *, win_points + dialer_points + cycle_points + retention_points AS score,
               CASE WHEN win_points + dialer_points + cycle_points + retention_points >= 60 THEN 'Scale' WHEN win_points + dialer_points + cycle_points + retention_points >= 30 THEN 'Maintain'
                    WHEN win_points + dialer_points + cycle_points + retention_points >= 12 THEN 'Cap' ELSE 'Kill' END AS band FROM p""".strip())),
    "lead_score": (q(lambda w: scorecard.with_action(_leads(w)).select("company_key", "score", "band", "action")), sql("meetings company", LEAD_SQL + """
        SELECT company_key, score, band, CASE band WHEN 'Dial' THEN 'call' WHEN 'Nurture' THEN 'email' ELSE 'none' END AS action FROM banded""")),
    "lead_coverage": (q(lambda w: scorecard.coverage(_leads(w), w.deals())), sql("meetings company", LEAD_SQL + f"""
        , v AS (SELECT company_key, count(*) AS wins FROM deals WHERE is_won = 1 GROUP BY 1)
        SELECT band, count(*) AS companies, {big('coalesce(sum(wins), 0)')} AS wins, {pct('count(*)', 'sum(count(*)) OVER ()', 1)} AS universe_pct, {pct('coalesce(sum(wins), 0)', 'sum(coalesce(sum(wins), 0)) OVER ()', 1)} AS wins_pct
        FROM banded b LEFT JOIN v ON v.company_key = b.company_key GROUP BY band""")),
    "lead_boost": (q(lambda w: scorecard.before_after(_boosted(w))), sql("meetings company", LEAD_SQL + """
        , q AS (SELECT band, score + CASE WHEN (company_key * 37) % 1000 / 1000.0 >= 0.5 THEN 20 ELSE 0 END AS s2 FROM banded),
        z AS (SELECT 'before' AS stage, band FROM q UNION ALL SELECT 'after', CASE WHEN s2 >= 50 THEN 'Dial' WHEN s2 >= 5 THEN 'Nurture' ELSE 'Skip' END FROM q)
        SELECT stage, band, count(*) AS companies FROM z GROUP BY ALL""")),
    "additive_score": (q(lambda w: scorecard.additive(w.entity_flags(), POINTS).select("entity_id", "score")), sql("flags", f"SELECT entity_id, {INTENT} AS score FROM flags")),
    # -- measures -----------------------------------------------------------------------------------
    "measures_total": (_measures(" ".join(DEAL_MEASURES), []), sql("deals_wide", f"SELECT {DEAL_LIST} FROM deals_wide")),
    "measures_by_channel": (_measures(" ".join([*DEAL_MEASURES, "volume_share", "won_mrr_share", "rebooking_trap_flag"]), ["channel_name"]), sql("deals_wide dim_channel", f"""
        SELECT channel_name, {DEAL_LIST}, {_r6('CAST(count(*) AS DOUBLE) / sum(count(*)) OVER ()')} AS volume_share, {_r6(dbl('sum(mrr_usd)') + ' / CAST(sum(sum(mrr_usd)) OVER () AS DOUBLE)')} AS won_mrr_share,
               CASE WHEN channel_name = 'Urgent desk' THEN 1.0::DOUBLE ELSE 0 END AS rebooking_trap_flag FROM deals_wide JOIN dim_channel USING (channel_key) GROUP BY 1""")),
    "measures_by_band_month": (_measures(" ".join(DEAL_MEASURES), ["employee_band", "month_name"], where={"region": lambda c: c == "ASIA"}), sql("deals_wide company", f"""
        SELECT employee_band, monthname(created_date) AS month_name, {DEAL_LIST} FROM deals_wide JOIN company USING (company_key) WHERE region = 'ASIA' GROUP BY ALL""")),
    "measures_share_filtered": (_measures("volume_share won_mrr_share deals", ["industry"], where={"channel_name": lambda c: c == "Organic"}), sql("deals_wide company dim_channel", f"""
        SELECT industry, {_r6("CAST(count(*) FILTER (WHERE channel_name = 'Organic') AS DOUBLE) / count(*)")} AS volume_share,
               {_r6(dbl("sum(mrr_usd) FILTER (WHERE channel_name = 'Organic')") + ' / ' + dbl('sum(mrr_usd)'))} AS won_mrr_share, CAST(count(*) FILTER (WHERE channel_name = 'Organic') AS DOUBLE) AS deals
        FROM deals_wide JOIN company USING (company_key) JOIN dim_channel USING (channel_key) GROUP BY 1 HAVING count(*) FILTER (WHERE channel_name = 'Organic') > 0""")),
    "measures_lift_by_band": (_measures("sweet_spot_lift", ["employee_band"]), sql("deals_wide meetings company", f"""
        , d AS (SELECT employee_band, sum(is_won) AS w FROM deals_wide JOIN company USING (company_key) GROUP BY 1),
        m AS (SELECT employee_band, count(*) FILTER (WHERE meeting_status = 'Held') AS h FROM meetings JOIN company USING (company_key) GROUP BY 1),
        r AS (SELECT employee_band, CAST(w AS DOUBLE) / nullif(h, 0) AS rate FROM d JOIN m USING (employee_band))
        SELECT employee_band, {_r6("(SELECT rate FROM r WHERE employee_band = '6-20') - rate")} AS sweet_spot_lift FROM r""".strip())),
    "measures_cancel_by_reason": (_measures("cancellation_share_of_losses lost_deals", ["lost_reason"]), sql("deals_wide dim_lost_reason", f"""
        SELECT lost_reason, {_r6("(SELECT CAST(count(*) AS DOUBLE) FROM deals_wide WHERE is_lost = 1 AND lost_reason_key = 0) / nullif(sum(is_lost), 0)")} AS cancellation_share_of_losses, {dbl('sum(is_lost)')} AS lost_deals
        FROM deals_wide JOIN dim_lost_reason USING (lost_reason_key) GROUP BY 1""")),
    "measures_cross_fact": (_measures(CROSS, ["industry"]), _cross_sql("industry", "industry")),
    "measures_cross_fact_wide": (_measures(CROSS, ["region", "employee_band"]), _cross_sql("region, employee_band", "region, employee_band")),
    "measures_segment_flags": (_measures("anti_icp_flag sweet_spot_lift cancellation_share_of_losses", ["industry"]), sql("deals_wide meetings company", f"""
        , d AS (SELECT industry, {dbl('sum(is_won)')} AS w, {dbl('sum(is_won) FILTER (WHERE employee_band = $$6-20$$)')} AS sw, {dbl('count(*) FILTER (WHERE is_lost = 1 AND lost_reason_key = 0)')} / nullif(sum(is_lost), 0) AS cs FROM deals_wide JOIN company USING (company_key) GROUP BY 1),
        m AS (SELECT industry, count(*) FILTER (WHERE meeting_status = 'Held') AS h, count(*) FILTER (WHERE meeting_status = 'Held' AND employee_band = '6-20') AS sh FROM meetings JOIN company USING (company_key) GROUP BY 1)
        SELECT industry, CASE WHEN industry IN ('FURNITURE', 'MACHINERY') THEN 1.0::DOUBLE ELSE 0 END AS anti_icp_flag, {_r6('sw / nullif(sh, 0) - w / nullif(h, 0)')} AS sweet_spot_lift, {_r6('cs')} AS cancellation_share_of_losses
        FROM d JOIN m USING (industry)""".strip())),
    "measures_meetings_by_channel": (_measures("meetings_held meeting_cancel_rate", ["channel_name"]), sql("meetings dim_channel", f"""
        SELECT channel_name, CAST(count(*) FILTER (WHERE meeting_status = 'Held') AS DOUBLE) AS meetings_held, {_r6("avg(CASE WHEN meeting_status = 'Cancelled' THEN 1 ELSE 0 END)")} AS meeting_cancel_rate
        FROM meetings JOIN dim_channel USING (channel_key) GROUP BY 1""")),
    "measures_finance": (_measures("revenue revenue_confirmed cogs contribution outstanding core_gross_margin", ["product_key"]), sql("lines", f"""
        SELECT product_key, {_r6('r')} AS revenue, {_r6('p')} AS revenue_confirmed, {_r6('c')} AS cogs, {_r6('round(r - c, 4)')} AS contribution, {_r6('round(r - p, 4)')} AS outstanding, {_r6('(cr - cc) / nullif(cr, 0)')} AS core_gross_margin
        FROM (SELECT product_key, {dbl('sum(amount_expected)')} AS r, {dbl('sum(amount_confirmed)')} AS p, {dbl('sum(cost)')} AS c, {dbl('sum(amount_expected) FILTER (WHERE is_core)')} AS cr, {dbl('sum(cost) FILTER (WHERE is_core)')} AS cc FROM lines GROUP BY 1)""")),
    "measures_scores": (_measures("high_score_leads avg_predicted_probability precision_at_threshold", ["lang"]), sql("scored", f"""
        SELECT lang, CAST(count(*) FILTER (WHERE score >= 0.5) AS DOUBLE) AS high_score_leads, {_r6('CAST(sum(CAST(score AS DECIMAL(20,12))) AS DOUBLE) / count(*)')} AS avg_predicted_probability,
               {_r6('CAST(count(*) FILTER (WHERE score >= 0.5 AND label = 1) AS DOUBLE) / nullif(count(*) FILTER (WHERE score >= 0.5), 0)')} AS precision_at_threshold FROM scored GROUP BY 1""")),
    "measures_signals": (_measures("avg_signals_per_record signal_coverage avg_intent_score", []), sql("flags", f"""
        SELECT {_r6(f'avg({N_FLAGS})')} AS avg_signals_per_record, {_r6('avg(CASE WHEN has_views = 1 OR has_clicks = 1 OR has_signups = 1 THEN 1 ELSE 0 END)')} AS signal_coverage, {_r6(f'avg({INTENT})')} AS avg_intent_score FROM flags""")),
    "measures_plan": (_measures("total_to_produce what_if_need varieties_red needing_production", []), plan_sql(f"""
        SELECT {_r6(dbl('sum(CAST(production_need AS DECIMAL(18,4)))'))} AS total_to_produce, {_r6(dbl('sum(CAST(expected_sales * 1.1::DOUBLE - stock_on_hand - incoming AS DECIMAL(18,4)))'))} AS what_if_need,
               CAST(count(*) FILTER (WHERE status = 'red') AS DOUBLE) AS varieties_red, CAST(count(*) FILTER (WHERE production_need > 0) AS DOUBLE) AS needing_production FROM plan""")),
    "numbers_registry": (q(_numbers), sql("deals", """
        SELECT m AS metric, e AS expected, a AS actual FROM (
            SELECT 'deals' AS m, -1.0::DOUBLE AS e, CAST(count(*) AS DOUBLE) AS a FROM deals UNION ALL SELECT 'lost_and_won', 0.0, CAST(sum(is_won * is_lost) AS DOUBLE) FROM deals
            UNION ALL SELECT 'not_computed', 3.0, NULL) WHERE a IS NULL OR abs(a - e) > 0.05""")),
    # -- report pages ---------------------------------------------------------------------------------
    "report_overview": (q(lambda w: report.dataset(star(w), REGISTRY, "overview")), sql("deals_wide dim_channel", f"""
        , t AS (SELECT count(*) AS n, sum(is_won) AS w, {dbl('sum(mrr_usd)')} AS m FROM deals_wide),
        c AS (SELECT channel_name, count(*) AS n, sum(is_won) AS w, {dbl('sum(mrr_usd)')} AS m FROM deals_wide JOIN dim_channel USING (channel_key) GROUP BY 1)
        SELECT v AS visual, k AS category, CAST(NULL AS VARCHAR) AS legend, round(x, 6) AS value FROM (
            SELECT 'deals' AS v, NULL AS k, CAST(n AS DOUBLE) AS x FROM t UNION ALL SELECT 'won', NULL, w FROM t UNION ALL SELECT 'win_rate', NULL, CAST(w AS DOUBLE) / n FROM t
            UNION ALL SELECT 'mrr', NULL, m FROM t UNION ALL SELECT 'avg_mrr', NULL, m / w FROM t UNION ALL SELECT 'win_rate_by_channel', channel_name, CAST(w AS DOUBLE) / n FROM c
            UNION ALL SELECT 'mrr_by_channel', channel_name, m FROM c UNION ALL SELECT 'deals_by_channel', channel_name, n FROM c)""".strip())),
    "report_channel_segments": (q(lambda w: report.dataset(star(w), REGISTRY, "channel_segments")), sql("deals dim_channel company", """
        , d AS (SELECT * FROM deals JOIN dim_channel USING (channel_key) JOIN company USING (company_key))
        SELECT 'by_channel' AS visual, channel_name AS category, CAST(NULL AS VARCHAR) AS legend, round(avg(is_won), 6) AS value FROM d GROUP BY channel_name
        UNION ALL SELECT 'by_band', employee_band, NULL, round(avg(is_won), 6) FROM d GROUP BY employee_band UNION ALL SELECT 'by_industry', industry, NULL, round(avg(is_won), 6) FROM d GROUP BY industry
        UNION ALL SELECT 'channel_by_band', channel_name, employee_band, round(avg(is_won), 6) FROM d GROUP BY channel_name, employee_band""".strip())),
    **{f"report_{page}": (q(lambda w, page=page: report.dataset(star(w), REGISTRY, page)), text) for page, text in PAGE_SQL.items()},
    # -- model metrics --------------------------------------------------------------------------------
    "model_auc": (q(lambda w: ml.auc(w.scored())), sql("scored", SCORED_CURVE + f"""
        SELECT {big('any_value(p)')} AS positives, {big('any_value(n)')} AS negatives, round({dbl('sum(neg * ((tp - pos) + pos / 2.0::DOUBLE))')} / ({dbl('any_value(p)')} * {dbl('any_value(n)')}), 8) AS auc FROM r""")),
    "model_auc_by_lang": (q(lambda w: ml.auc_by(w.scored(), "lang")), sql("scored", f"""
        , c AS (SELECT lang, score, sum(label) AS pos, count(*) - sum(label) AS neg FROM scored GROUP BY ALL),
        r AS (SELECT *, sum(pos) OVER (PARTITION BY lang ORDER BY score DESC) AS tp FROM c)
        SELECT lang, round({dbl('sum(neg * ((tp - pos) + pos / 2.0::DOUBLE))')} / nullif({dbl('sum(pos)')} * {dbl('sum(neg)')}, 0), 8) AS auc FROM r GROUP BY 1""".strip())),
    "model_drift": (q(lambda w: ml.drift(ml.auc_by(w.scored().withColumn("week", (F.col("doc_id") % 4).cast("int")), "week").withColumn("model", F.lit("m1")))), sql("scored", f"""
        , c AS (SELECT CAST(doc_id % 4 AS INTEGER) AS week, score, sum(label) AS pos, count(*) - sum(label) AS neg FROM scored GROUP BY ALL),
        r AS (SELECT *, sum(pos) OVER (PARTITION BY week ORDER BY score DESC) AS tp FROM c),
        a AS (SELECT week, round({dbl('sum(neg * ((tp - pos) + pos / 2.0::DOUBLE))')} / nullif({dbl('sum(pos)')} * {dbl('sum(neg)')}, 0), 8) AS auc FROM r GROUP BY 1)
        SELECT week, auc, 'm1' AS model, round(auc - lag(auc) OVER (ORDER BY week), 8) AS change, coalesce(round(auc - lag(auc) OVER (ORDER BY week), 8) < -0.02, false) AS alert FROM a""".strip())),
    "model_roc": (q(lambda w: ml.roc(w.scored())), sql("scored", SCORED_CURVE + """
        SELECT score AS threshold, round(CAST(fp AS DOUBLE) / n, 8) AS fpr, round(CAST(tp AS DOUBLE) / p, 8) AS tpr FROM r""")),
    "model_confusion": (q(lambda w: ml.confusion(w.scored())), sql("scored", "SELECT label AS actual, CAST(score >= 0.5 AS INTEGER) AS predicted, count(*) AS n FROM scored GROUP BY ALL")),
    "model_calibration": (q(lambda w: ml.calibration(w.scored())), sql("scored", """
        SELECT CAST(least(floor(score * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(CAST(sum(CAST(score AS DECIMAL(20,12))) AS DOUBLE) / count(*), 8) AS mean_score, round(avg(CAST(label AS DOUBLE)), 8) AS positive_rate FROM scored GROUP BY 1""")),
    "model_score_hist": (q(lambda w: ml.score_hist(w.scored()).drop("bin_lo")), sql("scored", """
        SELECT label, CAST(least(floor(score / (1.0::DOUBLE / 30)), 29) AS INTEGER) AS bin, count(*) AS n FROM scored GROUP BY ALL""")),
    "model_segment_scores": (q(lambda w: ml.segment_scores(w.scored(), "source")), sql("scored", """
        SELECT source, count(*) AS n, round(CAST(sum(CAST(score AS DECIMAL(20,12))) AS DOUBLE) / count(*), 8) AS avg_score, count(*) FILTER (WHERE score >= 0.5) AS high_scores FROM scored GROUP BY 1""")),
    "model_precision": (q(lambda w: ml.precision_at(w.scored(), 0.7)), sql("scored", """
        SELECT count(*) FILTER (WHERE score >= 0.7 AND label = 1) AS tp, count(*) FILTER (WHERE score >= 0.7 AND label = 0) AS fp, round(avg(CAST(label AS DOUBLE)) FILTER (WHERE score >= 0.7), 8) AS precision FROM scored""")),
    "model_top_decile_lift": (q(lambda w: ml.top_decile_lift(w.scored())), sql("scored", """
        , e AS (SELECT score, CAST(score AS DECIMAL(20,12)) AS s, rank() OVER (ORDER BY score DESC) <= (SELECT ceil(count(*) * 0.1::DOUBLE) FROM scored) AS t FROM scored),
        g AS (SELECT count(*) FILTER (WHERE t) AS n, CAST(sum(s) FILTER (WHERE t) AS DOUBLE) / count(*) FILTER (WHERE t) AS a, CAST(sum(s) AS DOUBLE) / count(*) AS b FROM e)
        SELECT n AS n_top, round(a, 8) AS top_mean, round(b, 8) AS base_mean, round(a / b, 6) AS lift FROM g""".strip())),
    "model_top_rows": (q(lambda w: top_fraction(w.scored(), "score", 0.25).select("doc_id", "score")), sql("scored", """
        SELECT doc_id, score FROM scored QUALIFY rank() OVER (ORDER BY score DESC) <= (SELECT ceil(count(*) * 0.25::DOUBLE) FROM scored)""")),
    "model_lift_curve": (q(lambda w: ml.lift_curve(w.scored())), sql("scored", SCORED_CURVE + f"""
        SELECT CAST(i AS INTEGER) AS step, {big('tp + fp')} AS seen, {big('tp')} AS positives, round((CAST(tp AS DOUBLE) / (tp + fp)) / (CAST(p AS DOUBLE) / (p + n)), 6) AS lift
        FROM r, range(1, 11) x(i) WHERE (tp + fp) * 10 >= i * (p + n) AND (tp + fp - pos - neg) * 10 < i * (p + n)""")),
    "model_split": (q(lambda w: ml.stratified_split(w.scored().select("doc_id", "label"), "label", "doc_id")), sql("scored", """
        SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) <= round(count(*) OVER (PARTITION BY label) * 0.2::DOUBLE) AS is_test FROM scored""")),
    "model_trees": (q(_gbt), None),
    # -- signal scoring ---------------------------------------------------------------------------------
    "signal_contribution": (q(lambda w: signals.contribution(w.entity_flags(), POINTS)), sql("flags", " UNION ALL ".join(
        f"SELECT '{c}' AS signal, {big(f'sum({c})')} AS records_with_signal, {p} AS pts_per_record, {big(f'sum({c}) * {p}')} AS total_pts_contribution FROM flags" for c, p in POINTS.items()))),
    "signal_ablation": (q(lambda w: signals.ablation(flags(w), POINTS)), sql("flags", " UNION ALL ".join(
        f"SELECT '{c}' AS signal, round(avg({INTENT}) - avg({INTENT} - {c} * {p}), 6) AS score_loss_if_removed FROM flags" for c, p in POINTS.items()))),
    "signal_coverage": (q(lambda w: signals.coverage(w.entity_flags(), list(POINTS), ["has_views", "has_clicks", "has_signups"])), sql("flags", f"""
        SELECT count(*) AS records, count(*) FILTER (WHERE {N_FLAGS} >= 1) AS at_least_1, count(*) FILTER (WHERE {N_FLAGS} >= 2) AS at_least_2, count(*) FILTER (WHERE {N_FLAGS} >= 3) AS at_least_3,
               round(avg({N_FLAGS}), 6) AS avg_signals, count(*) FILTER (WHERE has_views + has_clicks + has_signups > 0) AS covered, round(avg(CASE WHEN has_views + has_clicks + has_signups > 0 THEN 1 ELSE 0 END), 6) AS coverage FROM flags""")),
    "signal_lift": (q(lambda w: signals.lift(flags(w), list(POINTS))), sql("flags", " UNION ALL ".join(
        f"SELECT '{c}' AS signal, round(avg({INTENT}) FILTER (WHERE {c} = 1), 6) AS avg_present, round(avg({INTENT}) FILTER (WHERE {c} = 0), 6) AS avg_absent, round(avg({INTENT}) FILTER (WHERE {c} = 1) - avg({INTENT}) FILTER (WHERE {c} = 0), 6) AS lift FROM flags" for c in POINTS))),
    "signal_score_by_total": (q(lambda w: signals.score_by_total(flags(w), list(POINTS))), sql("flags", f"SELECT {N_FLAGS} AS n_signals, count(*) AS records, round(avg({INTENT}), 6) AS avg_score FROM flags GROUP BY 1")),
}

assert not measures.guard(REGISTRY, ["win_rate", "net_revenue_retention", "revenue"])
