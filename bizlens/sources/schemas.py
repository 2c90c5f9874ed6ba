"""Explicit schemas of the star tables; inference is never used."""

from __future__ import annotations

import re

from pyspark.sql.types import StructType

MONEY = "decimal(12,2)"


def _schema(columns: str) -> StructType:
    """``name type`` pairs; needs no running session, so schemas can be module constants."""
    names = {"int": "integer", "bigint": "long"}
    out = StructType()
    for name, kind in re.findall(r"(\w+)\s+(\w+(?:\(\d+,\d+\))?)", columns):
        out.add(name, names.get(kind, kind))
    return out


DIM_DATE = _schema("""date_key int, date date, year int, quarter int, month int, month_name string,
    week_of_year int, day_of_week string, is_business_day boolean""")
DIM_COMPANY = _schema("""company_key string, company_name string, industry string, employee_band string,
    revenue_band_usd string, region string, accounting_system string, company_type string, company_age_band string""")
DIM_COMPANY_BY_FORM = _schema("""company_key string, company_name string, industry string, employee_band string,
    revenue_band_usd string, region string, company_form string, company_age_band string""")
DIM_REP = _schema("rep_key string, rep_name string, rep_team string, tenure_band string")
DIM_CAMPAIGN = _schema("campaign_key string, campaign_name string, segment string, launch_date date")
DIM_CAMPAIGN_BY_CHANNEL = _schema("campaign_key string, campaign_name string, channel_key string, segment string, launch_date date")
DIM_STAGE = _schema("stage_key string, stage_name string, stage_order int, funnel_step string")
DIM_LOST_REASON = _schema("lost_reason_key string, lost_reason string, reason_category string")
DIM_SOURCE = _schema("source_key string, source_name string, channel string")
DIM_CHANNEL = _schema("channel_key string, channel_name string, channel_group string, is_dialer_motion int, cost_model string")
FACT_CALLS = _schema("""call_key string, company_key string, rep_key string, call_date_key int, call_outcome string,
    attempts_count int, call_duration_sec int, is_connected int, is_meeting_booked int""")
FACT_MEETINGS = _schema("""meeting_key string, deal_key string, company_key string, rep_key string, meeting_date_key int,
    meeting_status string, no_show_flag int, days_from_create int, days_to_close int""")
FACT_MEETINGS_BY_CHANNEL = _schema("""meeting_key string, deal_key string, company_key string, channel_key string,
    rep_key string, meeting_date_key int, meeting_status string, no_show_flag int, days_from_first_touch int, days_to_close int""")
FACT_DEALS = _schema(f"""deal_key string, company_key string, rep_key string, source_key string, stage_key string,
    lost_reason_key string, created_date_key int, won_date_key int, lost_date_key int, mrr_usd {MONEY}, tcv_usd {MONEY},
    deal_age_days int, is_won int, is_lost int""")
FACT_DEALS_BY_CHANNEL = _schema(f"""deal_key string, company_key string, rep_key string, channel_key string,
    campaign_key string, stage_key string, lost_reason_key string, created_date_key int, won_date_key int,
    lost_date_key int, mrr_usd {MONEY}, tcv_usd {MONEY}, deal_age_days int, is_won int, is_lost int,
    dialer_hours_attributed decimal(8,2), churn_date_key int, is_churned int, retained_months int, churned_mrr {MONEY}""")
FACT_TOUCHES = _schema("""touch_key string, company_key string, channel_key string, rep_key string, touch_date_key int,
    touch_outcome string, touch_dialer_minutes int, led_to_deal int""")
COMPANIES_LABELLED = _schema("""cvr string, company_name string, company_form string, industry_nace string, region string,
    founded_year int, employee_band string, vat_frequency string, has_subsidiaries boolean, uses_target_software boolean""")
PRODUCT_PARAMS = _schema("""product_key string, variety_name string, active boolean, red_threshold double,
    safety_floor double, safety_months double""")
FORECAST_SALES = _schema("product_key string, sales_year string, channel string, qty_1000 double")
STOCK_ON_HAND = _schema("product_key string, as_of_date date, qty_1000 double, source string")
INCOMING_PRODUCTION = _schema("product_key string, arrival_date date, qty_1000 double")
PRODUCTION_PLAN = _schema("""snapshot_id string, snapshot_date date, product_key string, sales_year string,
    expected_sales double, stock_on_hand double, incoming double, production_need double, ending_stock double,
    status string, action string, committed_by string""")
FCT_REVENUE = _schema(f"""invoice_no string, line_id bigint, date_key date, recognition_date date, customer_key string,
    product_key string, bucket_key string, amount_expected {MONEY}, amount_confirmed {MONEY}, cost {MONEY},
    qty_1000 double, is_core boolean, line_type string""")

# The two outreach stars and the planning inputs, as loadable sets.
OUTBOUND_STAR = {
    "dim_date": DIM_DATE, "dim_company": DIM_COMPANY, "dim_rep": DIM_REP, "dim_campaign": DIM_CAMPAIGN,
    "dim_stage": DIM_STAGE, "dim_lost_reason": DIM_LOST_REASON, "dim_source": DIM_SOURCE,
    "fact_calls": FACT_CALLS, "fact_meetings": FACT_MEETINGS, "fact_deals": FACT_DEALS,
}
CHANNEL_STAR = {
    "dim_date": DIM_DATE, "dim_company": DIM_COMPANY_BY_FORM, "dim_rep": DIM_REP, "dim_campaign": DIM_CAMPAIGN_BY_CHANNEL,
    "dim_channel": DIM_CHANNEL, "dim_stage": DIM_STAGE, "dim_lost_reason": DIM_LOST_REASON,
    "fact_touches": FACT_TOUCHES, "fact_meetings": FACT_MEETINGS_BY_CHANNEL, "fact_deals": FACT_DEALS_BY_CHANNEL,
}
PLANNING_INPUTS = {
    "product_params": PRODUCT_PARAMS, "forecast_sales": FORECAST_SALES,
    "stock_on_hand": STOCK_ON_HAND, "incoming_production": INCOMING_PRODUCTION,
}
