"""Funnel, segment, loss, velocity, channel and retention queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from bizlens.functions.dates import date_key, key_to_date, shift_key
from bizlens.functions.metrics import rate
from bizlens.operators import aggregate, joins, ordering, quality
from bizlens.plans import channel, cohort, funnel, loss, retention, segments, velocity
from bizlens.registry.base_sql import big, dbl, pct, sql
from bizlens.registry.common import q
from bizlens.sources.calendar import with_date_parts

BANDS = {
    "Scale": ["Organic", "Existing accounts"], "Maintain": ["Paid ads"], "Cap": ["High desk"], "Kill": ["Urgent desk"],
}
SWEET_SPOT = "6-20"


QUERIES = {
    # -- funnel -----------------------------------------------------------------------------------
    "funnel_waterfall": (q(lambda w: funnel.waterfall(w.calls(), w.meetings(), w.deals())), sql("calls meetings deals", """
        SELECT 1 AS step_order, 'Calls Attempted' AS funnel_step, count(*) AS records FROM calls
        UNION ALL SELECT 2, 'Calls Connected', CAST(sum(is_connected) AS BIGINT) FROM calls
        UNION ALL SELECT 3, 'Meetings Booked', CAST(sum(is_meeting_booked) AS BIGINT) FROM calls
        UNION ALL SELECT 4, 'Meetings Held', count(*) FILTER (WHERE meeting_status = 'Held') FROM meetings
        UNION ALL SELECT 5, 'Deals Won', CAST(sum(is_won) AS BIGINT) FROM deals""")),
    "funnel_step_rates": (q(lambda w: funnel.step_rates(w.calls(), w.meetings(), w.deals())), sql("calls meetings deals", f"""
        SELECT {pct('connected', 'calls')} AS connect_rate_pct, {pct('booked', 'connected')} AS meeting_book_rate_pct,
               {pct('held', 'booked')} AS meeting_show_rate_pct, {pct('won', 'held')} AS won_from_meeting_pct, {pct('won', 'calls')} AS overall_win_rate_pct
        FROM (SELECT (SELECT count(*) FROM calls) AS calls, (SELECT sum(is_connected) FROM calls) AS connected,
                     (SELECT sum(is_meeting_booked) FROM calls) AS booked, (SELECT count(*) FROM meetings WHERE meeting_status = 'Held') AS held,
                     (SELECT sum(is_won) FROM deals) AS won)""")),
    "rep_leaderboard": (q(lambda w: funnel.rep_leaderboard(w.rep(), w.calls(), w.deals_wide())), sql("rep calls deals_wide", f"""
        SELECT r.rep_key, rep_name, rep_team, total_calls, connected_calls, meetings_booked, coalesce(deals_won, 0) AS deals_won,
               coalesce(round(won_mrr, 0), 0) AS won_mrr_usd, {pct('meetings_booked', 'total_calls')} AS meeting_rate_pct
        FROM rep r
        JOIN (SELECT rep_key, count(*) AS total_calls, {big('sum(is_connected)')} AS connected_calls, {big('sum(is_meeting_booked)')} AS meetings_booked FROM calls GROUP BY 1) c ON c.rep_key = r.rep_key
        LEFT JOIN (SELECT rep_key, {big('sum(is_won)')} AS deals_won, {dbl('sum(mrr_usd) FILTER (WHERE is_won = 1)')} AS won_mrr FROM deals_wide GROUP BY 1) d ON d.rep_key = r.rep_key
        WHERE total_calls >= 50""")),
    "dropoff_by_source": (q(lambda w: funnel.dropoff_by_source(w.deals(), w.dim_source(), w.dim_stage())), sql("deals dim_source dim_stage", f"""
        SELECT source_name, count(*) AS deals, {big('sum(CASE WHEN s.stage_order >= 3 THEN 1 ELSE 0 END)')} AS reached_meeting,
               {big('sum(is_won)')} AS won, max(is_won) AS any_won, {pct('sum(is_won)', 'count(*)', 1)} AS win_rate_pct
        FROM deals d JOIN dim_source USING (source_key) JOIN dim_stage s ON s.stage_order = d.stage_order GROUP BY source_name""")),
    # -- segments ---------------------------------------------------------------------------------
    "win_rate_by_industry": (q(lambda w: segments.win_rate(w.deals(), w.company(), ["industry"])), sql("deals company", f"""
        SELECT industry, count(*) AS total_deals, {big('sum(is_won)')} AS won, {big('sum(is_lost)')} AS lost,
               round({dbl('sum(mrr_usd) FILTER (WHERE is_won = 1)')} / nullif(sum(is_won), 0), 2) AS avg_won_mrr_usd, {pct('sum(is_won)', 'count(*)')} AS win_rate_pct
        FROM deals JOIN company USING (company_key) GROUP BY industry""")),
    "held_win_rate_by_band": (q(lambda w: segments.held_win_rate(w.deals(), w.meetings(), w.company(), ["employee_band"])), sql("deals company meetings", f"""
        SELECT employee_band, count(*) AS held_deals, {big('sum(is_won)')} AS won, {pct('sum(is_won)', 'count(*)')} AS win_rate_pct
        FROM deals JOIN company USING (company_key) WHERE deal_key IN (SELECT deal_key FROM meetings WHERE meeting_status = 'Held') GROUP BY employee_band""")),
    "flat_control": (q(lambda w: segments.flat_control(w.deals(), w.company(), "region")), sql("deals company", f"""
        SELECT count(*) AS segments, min(r) AS min_rate_pct, max(r) AS max_rate_pct, round(max(r) - min(r), 2) AS spread_pts
        FROM (SELECT region, {pct('sum(is_won)', 'count(*)')} AS r FROM deals JOIN company USING (company_key) GROUP BY region)""")),
    "heatmap_industry_band": (q(lambda w: segments.heatmap(w.deals(), w.company())), sql("deals company", f"""
        SELECT industry, employee_band, count(*) AS deals, {big('sum(is_won)')} AS won, {pct('sum(is_won)', 'count(*)', 1)} AS win_rate_pct
        FROM deals JOIN company USING (company_key) GROUP BY industry, employee_band""")),
    "anti_segment_combined": (q(lambda w: segments.combined(segments.held(w.deals(), w.meetings()), w.company(), "industry", ["FURNITURE", "MACHINERY"])), sql("deals company meetings", f"""
        SELECT count(*) AS held_deals, coalesce({big('sum(is_won)')}, 0) AS won, {pct('sum(is_won)', 'count(*)')} AS win_rate_pct
        FROM deals JOIN company USING (company_key) WHERE industry IN ('FURNITURE', 'MACHINERY') AND deal_key IN (SELECT deal_key FROM meetings WHERE meeting_status = 'Held')""")),
    "sweet_spot_lift": (q(lambda w: segments.lift(segments.held(w.deals(), w.meetings()), w.company(), "employee_band", SWEET_SPOT)), sql("deals company meetings", """
        SELECT segment_n, round(s, 6) AS segment_rate, round(r, 6) AS rest_rate, round(b, 6) AS baseline_rate,
               round(s - b, 6) AS lift_points, round(s / nullif(r, 0), 4) AS lift_vs_rest
        FROM (SELECT count(*) FILTER (WHERE employee_band = '6-20') AS segment_n, avg(is_won) FILTER (WHERE employee_band = '6-20') AS s,
                     avg(is_won) FILTER (WHERE employee_band <> '6-20') AS r, avg(is_won) AS b
              FROM deals JOIN company USING (company_key) WHERE deal_key IN (SELECT deal_key FROM meetings WHERE meeting_status = 'Held'))""")),
    "rep_spread": (q(lambda w: segments.spread(w.deals_wide().join(w.meetings().filter("meeting_status = 'Held'").select("deal_key"), "deal_key", "left_semi").filter("rep_key is not null"), "rep_key")), sql("deals_wide meetings", """
        , r AS (SELECT rep_key, avg(is_won) AS rate FROM deals_wide WHERE rep_key IS NOT NULL AND deal_key IN (SELECT deal_key FROM meetings WHERE meeting_status = 'Held') GROUP BY 1),
        o AS (SELECT *, row_number() OVER (ORDER BY rate DESC, rep_key) AS rn FROM r)
        SELECT (SELECT count(*) FROM r) AS members, (SELECT rep_key FROM o WHERE rn = 1) AS top_key, round((SELECT rate FROM o WHERE rn = 1), 4) AS top_rate,
               round((SELECT rate FROM o WHERE rn = 2), 4) AS second_rate, round((SELECT quantile_cont(round(rate, 6), 0.5) FROM r), 4) AS median_rate,
               round((SELECT min(rate) FROM r), 4) AS bottom_rate, round((SELECT max(rate) FROM r) / greatest((SELECT min(rate) FROM r), 1e-9), 2) AS top_to_bottom""".strip())),
    "positive_rate_by_lang": (q(lambda w: segments.positive_rate(w.scored(), "lang", "label")), sql("scored", """
        SELECT lang, count(*) AS n, round(avg(label), 3) AS positive_rate FROM scored GROUP BY lang""")),
    "won_economics": (q(lambda w: segments.economics(w.deals())), sql("deals", f"""
        SELECT count(*) AS won, {dbl('sum(mrr_usd)')} AS won_mrr, round({dbl('sum(mrr_usd)')} / count(*), 2) AS avg_mrr FROM deals WHERE is_won = 1""")),
    # -- losses -----------------------------------------------------------------------------------
    "lost_reason_pareto": (q(lambda w: loss.pareto(w.deals(), w.dim_lost_reason())), sql("deals dim_lost_reason", f"""
        SELECT lost_reason_key, reason_category, lost_reason, n AS lost_deals, {pct('n', 'sum(n) OVER ()')} AS pct_of_losses,
               {pct('sum(n) OVER (ORDER BY n DESC, lost_reason_key ROWS UNBOUNDED PRECEDING)', 'sum(n) OVER ()')} AS cum_pct
        FROM (SELECT lost_reason_key, reason_category, lost_reason, count(*) AS n FROM deals JOIN dim_lost_reason USING (lost_reason_key) WHERE is_lost = 1 GROUP BY ALL)""")),
    "lost_reason_by_group": (q(lambda w: loss.rank_in_group(loss.by_group(w.deals(), w.dim_channel(), w.dim_lost_reason()))), sql("deals dim_channel dim_lost_reason", f"""
        SELECT channel_group, reason_category, n AS losses, {pct('n', 'sum(n) OVER (PARTITION BY channel_group)', 1)} AS pct_of_group_losses,
               CAST(row_number() OVER (PARTITION BY channel_group ORDER BY n DESC, reason_category) AS INTEGER) AS rank
        FROM (SELECT channel_group, reason_category, count(*) AS n FROM deals JOIN dim_channel USING (channel_key) JOIN dim_lost_reason USING (lost_reason_key) WHERE is_lost = 1 GROUP BY ALL)""")),
    "loss_mix": (q(lambda w: loss.mix(w.deals(), w.dim_lost_reason())), sql("deals dim_lost_reason", f"""
        SELECT reason_category, count(*) AS losses, {pct('count(*)', '(SELECT count(*) FROM deals WHERE is_lost = 1)', 1)} AS share_pct
        FROM deals JOIN dim_lost_reason USING (lost_reason_key) WHERE is_lost = 1 GROUP BY 1""")),
    "cancellation_share": (q(lambda w: loss.reason_share(w.deals(), w.dim_lost_reason(), "Meeting cancelled")), sql("deals", f"""
        SELECT count(*) FILTER (WHERE lost_reason_key = 0) AS with_reason, count(*) AS lost, {pct('count(*) FILTER (WHERE lost_reason_key = 0)', 'count(*)')} AS share_pct FROM deals WHERE is_lost = 1""")),
    # -- velocity and cohorts -----------------------------------------------------------------------
    "velocity_summary": (q(lambda w: velocity.summary(w.meetings())), sql("meetings", """
        SELECT 'days_call_to_meeting' AS metric, round(avg(days_from_create), 1) AS avg_days, quantile_cont(days_from_create, 0.5) AS median_days, round(quantile_cont(days_from_create, 0.9), 4) AS p90_days FROM meetings
        UNION ALL SELECT 'days_meeting_to_close', round(avg(days_to_close), 1), quantile_cont(days_to_close, 0.5), round(quantile_cont(days_to_close, 0.9), 4) FROM meetings""")),
    "velocity_by_channel": (q(lambda w: velocity.by_channel(w.deals_wide(), w.dim_channel())), sql("deals_wide dim_channel", """
        SELECT channel_name, count(*) AS won_deals, round(quantile_cont(deal_age_days, 0.25), 4) AS p25_days, round(quantile_cont(deal_age_days, 0.5), 4) AS median_days,
               round(quantile_cont(deal_age_days, 0.9), 4) AS p90_days FROM deals_wide JOIN dim_channel USING (channel_key) WHERE is_won = 1 GROUP BY 1""")),
    "velocity_split_30": (q(lambda w: velocity.split(w.meetings(), w.deals(), 30)), sql("meetings", """
        SELECT count(*) FILTER (WHERE days_to_close <= 30) AS n_within, round(avg(is_won) FILTER (WHERE days_to_close <= 30), 6) AS rate_within,
               count(*) FILTER (WHERE days_to_close > 30) AS n_beyond, round(avg(is_won) FILTER (WHERE days_to_close > 30), 6) AS rate_beyond
        FROM meetings m JOIN deals d ON d.deal_key = m.deal_key WHERE meeting_status = 'Held'""")),
    "cycle_histogram": (q(lambda w: velocity.cycle_histogram(w.meetings(), w.deals())), sql("meetings", """
        SELECT CAST(least(days_to_close // 100, 29) AS INTEGER) AS bin, count(*) AS n, 100.0::DOUBLE * least(days_to_close // 100, 29) AS bin_lo
        FROM meetings m JOIN deals d ON d.deal_key = m.deal_key WHERE is_won = 1 AND days_to_close BETWEEN 0 AND 3000 GROUP BY ALL""")),
    "monthly_won_cohort": (q(lambda w: cohort.monthly_won(w.deals_wide(), w.dim_date())), sql("deals_wide", f"""
        SELECT CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month, monthname(d) AS month_name, count(*) AS won_deals,
               round({dbl('sum(mrr_usd)')}, 0) AS won_mrr_usd, round({dbl('sum(deal_age_days)')} / count(*), 1) AS avg_cycle_days
        FROM (SELECT *, created_date + CAST(deal_age_days AS INTEGER) AS d FROM deals_wide WHERE is_won = 1 AND deal_age_days IS NOT NULL) GROUP BY ALL""")),
    # -- channels ---------------------------------------------------------------------------------
    "channel_scorecard": (q(lambda w: channel.scorecard(w.deals_wide(), w.dim_channel())), sql("deals_wide dim_channel", f"""
        SELECT channel_name, channel_group, count(*) AS deals, {big('sum(is_won)')} AS won, quantile_cont(deal_age_days, 0.5) FILTER (WHERE is_won = 1) AS t2w_median_days,
               {dbl('sum(mrr_usd)')} AS won_mrr, {pct('sum(is_won)', 'count(*)', 1)} AS win_rate_pct, round({dbl('sum(mrr_usd)')} / nullif(sum(dialer_hours), 0), 0) AS mrr_per_dialer_hr,
               {pct('count(*)', 'sum(count(*)) OVER ()', 1)} AS vol_share_pct
        FROM deals_wide JOIN dim_channel USING (channel_key) GROUP BY channel_name, channel_group""")),
    "channel_group_rollup": (q(lambda w: channel.group_rollup(w.deals(), w.dim_channel())), sql("deals dim_channel", f"""
        SELECT channel_group, count(*) AS deals, {big('sum(is_won)')} AS won, {dbl('sum(mrr_usd)')} AS won_mrr, {pct('sum(is_won)', 'count(*)', 1)} AS win_rate_pct,
               {pct('sum(mrr_usd)', 'sum(sum(mrr_usd)) OVER ()', 1)} AS won_mrr_share_pct FROM deals JOIN dim_channel USING (channel_key) GROUP BY 1""")),
    "channel_economics": (q(lambda w: channel.economics(w.deals_wide(), w.dim_channel())), sql("deals_wide dim_channel", f"""
        SELECT channel_name, channel_group, count(*) AS deals, {big('sum(is_won)')} AS won_deals, {dbl('sum(mrr_usd) FILTER (WHERE is_won = 1)')} AS won_mrr,
               {dbl('sum(mrr_usd - churned_mrr) FILTER (WHERE is_won = 1)')} AS net_won_mrr, sum(dialer_hours) AS dialer_hours, {pct('sum(is_won)', 'count(*)', 1)} AS win_rate_pct,
               round(100.0::DOUBLE * (1.0::DOUBLE - {dbl('sum(is_churned)')} / nullif({dbl('sum(is_won)')}, 0)), 1) AS m12_retention_pct,
               {pct('sum(mrr_usd - churned_mrr) FILTER (WHERE is_won = 1)', 'sum(mrr_usd) FILTER (WHERE is_won = 1)', 1)} AS nrr_pct
        FROM deals_wide JOIN dim_channel USING (channel_key) GROUP BY 1, 2""")),
    "channel_trap": (q(lambda w: channel.trap(w.deals(), w.meetings(), w.dim_channel(), "Urgent desk")), sql("meetings dim_channel", f"""
        , f AS (SELECT deal_key, max(CASE WHEN meeting_status = 'Cancelled' THEN 1 ELSE 0 END) AS c FROM meetings GROUP BY 1)
        SELECT channel_name, count(*) AS deals, {big('sum(is_won)')} AS won, {big('sum(c)')} AS cancelled, sum(dialer_hours) AS dialer_hours, {dbl('sum(mrr_usd)')} AS won_mrr,
               {pct('sum(is_won)', 'count(*)', 1)} AS win_rate_pct, {pct('sum(c)', 'count(*)', 1)} AS cancel_rate_pct
        FROM deals JOIN dim_channel USING (channel_key) JOIN f ON f.deal_key = deals.deal_key WHERE channel_name = 'Urgent desk' GROUP BY 1""".strip())),
    "channel_band_matrix": (q(lambda w: channel.matrix(w.deals(), w.dim_channel(), w.company())), sql("deals dim_channel company", f"""
        SELECT channel_name, employee_band, count(*) AS deals, {big('sum(is_won)')} AS won, {pct('sum(is_won)', 'count(*)', 1)} AS win_rate_pct
        FROM deals JOIN dim_channel USING (channel_key) JOIN company USING (company_key) GROUP BY 1, 2 HAVING count(*) >= 20""")),
    "motion_split": (q(lambda w: channel.motion_split(w.deals(), w.dim_channel())), sql("deals dim_channel", f"""
        SELECT CASE WHEN channel_group = 'Expansion' THEN 'Expansion' ELSE 'New acquisition' END AS motion, count(*) AS deals, {big('sum(is_won)')} AS won,
               {dbl('sum(mrr_usd)')} AS won_mrr, {pct('sum(is_won)', 'count(*)', 1)} AS win_rate_pct FROM deals JOIN dim_channel USING (channel_key) GROUP BY 1""")),
    "allocation_band_rollup": (q(lambda w: channel.band_rollup(w.deals_wide(), w.dim_channel(), BANDS)), sql("deals_wide dim_channel", f"""
        SELECT CASE WHEN channel_name IN ('Organic', 'Existing accounts') THEN 'Scale' WHEN channel_name = 'Paid ads' THEN 'Maintain'
                    WHEN channel_name = 'High desk' THEN 'Cap' WHEN channel_name = 'Urgent desk' THEN 'Kill' END AS band,
               count(*) AS deals, {pct('count(*)', 'sum(count(*)) OVER ()', 1)} AS deal_share_pct, {pct('sum(mrr_usd)', 'sum(sum(mrr_usd)) OVER ()', 1)} AS won_mrr_share_pct,
               round(100.0::DOUBLE * (1.0::DOUBLE - {dbl('sum(is_churned)')} / nullif({dbl('sum(is_won)')}, 0)), 1) AS m12_retention_pct,
               {pct('sum(mrr_usd - churned_mrr)', 'sum(sum(mrr_usd - churned_mrr)) OVER ()', 1)} AS net_mrr_share_pct,
               {pct('sum(dialer_hours)', 'sum(sum(dialer_hours)) OVER ()', 1)} AS dialer_hr_share_pct
        FROM deals_wide JOIN dim_channel USING (channel_key) GROUP BY 1""")),
    "resource_roi": (q(lambda w: channel.resource_roi(w.deals(), w.dim_channel())), sql("deals dim_channel", f"""
        SELECT h AS dialer_hours, m AS dialer_mrr, o AS other_mrr, round(m / nullif(h, 0), 2) AS mrr_per_hour, {pct('dn', 'n')} AS dialer_deal_share_pct, {pct('m', 't')} AS dialer_mrr_share_pct
        FROM (SELECT count(*) AS n, count(*) FILTER (WHERE is_dialer_motion = 1) AS dn, sum(dialer_hours) FILTER (WHERE is_dialer_motion = 1) AS h,
                     {dbl('sum(mrr_usd) FILTER (WHERE is_dialer_motion = 1 AND is_won = 1)')} AS m, {dbl('sum(mrr_usd) FILTER (WHERE is_dialer_motion = 0 AND is_won = 1)')} AS o,
                     {dbl('sum(mrr_usd) FILTER (WHERE is_won = 1)')} AS t FROM deals JOIN dim_channel USING (channel_key))""")),
    "touch_rollup": (q(lambda w: channel.touch_rollup(w.touches())), sql("touches", f"""
        , f AS (SELECT channel_key, count(*) AS n FROM (SELECT company_key, channel_key, row_number() OVER (PARTITION BY company_key ORDER BY touch_ts, touch_key) AS rn FROM touches) WHERE rn = 1 GROUP BY 1)
        SELECT t.channel_key, count(*) AS touches, {dbl('sum(minutes)')} AS minutes, {big('sum(led_to_deal)')} AS conversions, coalesce(any_value(f.n), 0) AS first_touches,
               {pct('sum(led_to_deal)', 'count(*)')} AS conversion_pct FROM touches t LEFT JOIN f ON f.channel_key = t.channel_key GROUP BY t.channel_key""".strip())),
    # -- retention --------------------------------------------------------------------------------
    "retention_by_channel": (q(lambda w: retention.by_channel(w.deals_wide(), w.dim_channel(), min_n=1000)), sql("deals_wide dim_channel", f"""
        SELECT channel_name, count(*) AS won_n, {big('sum(is_churned)')} AS churned_n, {dbl('sum(mrr_usd)')} AS won_mrr, {dbl('sum(churned_mrr)')} AS churned_mrr,
               round(100.0::DOUBLE * (1.0::DOUBLE - {dbl('sum(is_churned)')} / {dbl('count(*)')}), 1) AS m12_retention_pct, {pct('sum(mrr_usd - churned_mrr)', 'sum(mrr_usd)', 1)} AS nrr_pct,
               CASE WHEN count(*) < 1000 THEN 'small n - directional' ELSE '' END AS read_note FROM deals_wide JOIN dim_channel USING (channel_key) WHERE is_won = 1 GROUP BY 1""")),
    "retention_blended": (q(lambda w: retention.blended(w.deals_wide())), sql("deals_wide", f"""
        SELECT count(*) AS won_n, {big('sum(is_churned)')} AS churned_n, {dbl('sum(mrr_usd)')} AS won_mrr, {dbl('sum(churned_mrr)')} AS churned_mrr,
               round(100.0::DOUBLE * (1.0::DOUBLE - {dbl('sum(is_churned)')} / {dbl('count(*)')}), 1) AS m12_retention_pct, {pct('sum(mrr_usd - churned_mrr)', 'sum(mrr_usd)', 1)} AS nrr_pct
        FROM deals_wide WHERE is_won = 1""")),
    "survival_curve": (q(lambda w: retention.curve(w.deals_wide(), w.dim_channel())), sql("deals_wide dim_channel", f"""
        SELECT channel_group, count(*) AS won_n, m AS month, {big('sum(CASE WHEN retained_months >= m THEN 1 ELSE 0 END)')} AS alive,
               {pct('sum(CASE WHEN retained_months >= m THEN 1 ELSE 0 END)', 'count(*)')} AS survival_pct
        FROM deals_wide JOIN dim_channel USING (channel_key), (SELECT CAST(range AS INTEGER) AS m FROM range(13)) WHERE is_won = 1 GROUP BY channel_group, m""")),
    # -- generic operators on the same star -----------------------------------------------------------
    "crosstab_wide": (q(lambda w: aggregate.crosstab(w.deals().join(w.dim_channel(), "channel_key"), "channel_group", "is_lost", [0, 1], F.count(F.lit(1)))
                         .withColumnsRenamed({"0": "not_lost", "1": "lost"})), sql("deals dim_channel", """
        SELECT channel_group, count(*) FILTER (WHERE is_lost = 0) AS not_lost, count(*) FILTER (WHERE is_lost = 1) AS lost FROM deals JOIN dim_channel USING (channel_key) GROUP BY 1""")),
    "matrix_with_totals": (q(lambda w: aggregate.with_totals(w.deals().join(w.dim_channel(), "channel_key"), ["channel_group", "channel_name"],
                                                              [F.count(F.lit(1)).alias("deals"), F.sum("is_won").alias("won")]).withColumn("win_rate_pct", rate("won", "deals", digits=1))), sql("deals dim_channel", f"""
        SELECT channel_group, channel_name, CAST(grouping(channel_group, channel_name) AS INTEGER) AS level, count(*) AS deals, {big('sum(is_won)')} AS won,
               {pct('sum(is_won)', 'count(*)', 1)} AS win_rate_pct FROM deals JOIN dim_channel USING (channel_key) GROUP BY ROLLUP (channel_group, channel_name)""")),
    "deals_by_month": (q(lambda w: aggregate.by_month(w.deals(), "created_date", [F.count(F.lit(1)).alias("deals"), F.sum("is_won").alias("won")])), sql("deals", f"""
        SELECT CAST(date_trunc('month', created_date) AS DATE) AS month, count(*) AS deals, {big('sum(is_won)')} AS won FROM deals GROUP BY 1""")),
    "star_join_counts": (q(lambda w: joins.star_join(w.deals().select("channel_key", "source_key", "stage_order"), {"channel_key": w.dim_channel(), "source_key": w.dim_source(), "stage_order": w.dim_stage()})
                            .groupBy("channel_group", "source_name", "stage_name").agg(F.count(F.lit(1)).alias("deals"))), sql("deals dim_channel dim_source dim_stage", """
        SELECT channel_group, source_name, stage_name, count(*) AS deals FROM deals JOIN dim_channel USING (channel_key) JOIN dim_source USING (source_key) JOIN dim_stage USING (stage_order) GROUP BY ALL""")),
    "prior_cancels": (q(lambda w: ordering.prior_events(w.meetings().select("deal_key", "company_key", "meeting_date", "meeting_status"), "company_key", "meeting_date", ["deal_key"],
                                                         F.col("meeting_status") == "Cancelled", "prior_cancels").select("deal_key", "company_key", "prior_cancels")), sql("meetings", """
        SELECT deal_key, company_key, CAST(coalesce(sum(CASE WHEN meeting_status = 'Cancelled' THEN 1 ELSE 0 END) OVER (PARTITION BY company_key ORDER BY meeting_date, deal_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prior_cancels FROM meetings""")),
    "latest_meeting_per_company": (q(lambda w: ordering.latest_per_key(w.meetings().select("company_key", "meeting_date", "deal_key", "meeting_status"), ["company_key"], ["meeting_date", "deal_key"])), sql("meetings", """
        SELECT company_key, meeting_date, deal_key, meeting_status FROM meetings QUALIFY row_number() OVER (PARTITION BY company_key ORDER BY meeting_date DESC, deal_key DESC) = 1""")),
    "calendar_use": (q(lambda w: with_date_parts(w.deals().select("created_date").distinct(), "created_date")
                        .withColumns({"shifted": shift_key("date_key", 10, dt.date(1995, 1, 1), dt.date(2001, 6, 30)), "back": key_to_date("date_key")})), sql("deals", """
        SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, d AS date, CAST(year(d) AS INTEGER) AS year, CAST(quarter(d) AS INTEGER) AS quarter, CAST(month(d) AS INTEGER) AS month,
               monthname(d) AS month_name, CAST(weekofyear(d) AS INTEGER) AS week_of_year, dayname(d) AS day_of_week, isodow(d) <= 5 AS is_business_day,
               CAST(strftime(least(greatest(d + 10, DATE '1995-01-01'), DATE '2001-06-30'), '%Y%m%d') AS INTEGER) AS shifted, d AS back
        FROM (SELECT DISTINCT created_date AS d FROM deals)""")),
    "line_key_copies": (q(lambda w: quality.pk_violations(w.table("lineitem"), ["l_orderkey", "l_linenumber"])), """
        SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"""),
    "null_contract": (q(lambda w: quality.null_violations(w.deals_wide(), ["deal_key", "rep_key", "deal_age_days", "retained_months"])), sql("deals_wide", """
        SELECT unnest(['deal_key', 'rep_key', 'deal_age_days', 'retained_months']) AS column_name,
               unnest([count(*) - count(deal_key), count(*) - count(rep_key), count(*) - count(deal_age_days), count(*) - count(retained_months)]) AS nulls FROM deals_wide""")),
    "orphan_report": (q(lambda w: quality.orphan_report([
        ("orders-customer", w.table("orders"), "o_custkey", w.table("customer"), "c_custkey"),
        ("lineitem-orders", w.table("lineitem"), "l_orderkey", w.table("orders"), "o_orderkey"),
        ("lineitem-part", w.table("lineitem"), "l_partkey", w.table("part"), "p_partkey"),
        ("calls-rep", w.calls(), "rep_key", w.rep(), "rep_key")])), """
        SELECT 'orders-customer' AS link, count(DISTINCT o_custkey) AS orphan_keys, count(*) AS orphan_rows FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
        UNION ALL SELECT 'lineitem-orders', count(DISTINCT l_orderkey), count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
        UNION ALL SELECT 'lineitem-part', count(DISTINCT l_partkey), count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
        UNION ALL SELECT 'calls-rep', count(DISTINCT user_id), count(*) FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)"""),
    "deals_without_lines": (q(lambda w: w.deals().join(w.deal_lines(), "deal_key", "left_anti").select("deal_key", date_key("created_date").alias("created_key"))), sql("deals deal_lines", """
        SELECT deal_key, CAST(strftime(created_date, '%Y%m%d') AS INTEGER) AS created_key FROM deals WHERE deal_key NOT IN (SELECT deal_key FROM deal_lines)""")),
}
