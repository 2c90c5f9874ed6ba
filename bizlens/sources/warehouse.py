"""The generic trade tables (orders, lineitem, events, documents ...) read as the logical star.

Every method returns a lazy, narrow DataFrame; column pruning and filters reach the Parquet scan.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlens.functions.bands import band_when
from bizlens.functions.metrics import MONEY
from bizlens.operators.aggregate import collapse_to_grain
from bizlens.sources.calendar import dim_date
from bizlens.sources.readers import inline_table

# The small dimensions of the mapping and its reference date.
CHANNELS = [
    ("1-URGENT", "Urgent desk", "Outbound", 1),
    ("2-HIGH", "High desk", "Outbound", 1),
    ("3-MEDIUM", "Paid ads", "Paid", 0),
    ("4-NOT SPECIFIED", "Organic", "Inbound", 0),
    ("5-LOW", "Existing accounts", "Expansion", 0),
]
SOURCES = [(0, "Cold list"), (1, "Inbound form"), (2, "Re-booked")]
STAGES = [(1, "Lead"), (2, "Contacted"), (3, "Meeting"), (4, "Proposal"), (5, "Negotiation"), (6, "Won")]
LOST_REASONS = [
    (0, "Meeting cancelled", "Process"), (1, "No budget", "Budget"), (2, "Competitor chosen", "Competition"),
    (3, "Wrong time", "Timing"), (4, "Budget frozen", "Budget"), (5, "No fit", "Fit"), (6, "No reply", "Process"),
]
EMPLOYEE_BANDS = ["1-5", "6-20", "21-50", "51-200", "201-500", "500+"]
BAND_CUTS = [8000, 6000, 4000, 2000, 0]
AS_OF = dt.date(2001, 11, 5)
ARRIVALS_FROM = dt.datetime(2001, 1, 1)


class Warehouse:
    """Logical tables over one folder of Parquet files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # -- dimensions -----------------------------------------------------------------------------
    def dim_channel(self) -> DataFrame:
        return inline_table(
            self.spark, CHANNELS, "channel_key string, channel_name string, channel_group string, is_dialer_motion int")

    def dim_source(self) -> DataFrame:
        return inline_table(self.spark, SOURCES, "source_key int, source_name string")

    def dim_stage(self) -> DataFrame:
        return inline_table(self.spark, STAGES, "stage_order int, stage_name string")

    def dim_lost_reason(self) -> DataFrame:
        return inline_table(self.spark, LOST_REASONS, "lost_reason_key int, lost_reason string, reason_category string")

    def company(self) -> DataFrame:
        c, n, r = self.table("customer"), self.table("nation"), self.table("region")
        return (
            c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
            .select(
                F.col("c_custkey").alias("company_key"), F.col("c_name").alias("company_name"),
                F.col("c_mktsegment").alias("industry"), F.col("r_name").alias("region"), F.col("n_name").alias("country"),
                band_when("c_acctbal", BAND_CUTS, EMPLOYEE_BANDS[::-1]).alias("employee_band"))
        )

    def rep(self) -> DataFrame:
        s = self.table("supplier")
        return s.select(
            F.col("s_suppkey").alias("rep_key"), F.col("s_name").alias("rep_name"),
            F.concat(F.lit("team "), F.col("s_nationkey").cast("string")).alias("rep_team"))

    def dim_date(self) -> DataFrame:
        return dim_date(self.spark, "1992-01-01", "2010-12-31")

    # -- deals ----------------------------------------------------------------------------------
    def deals(self) -> DataFrame:
        """Deal facts that come from the order row alone: no shuffle."""
        won = F.col("o_orderstatus") == "F"
        key = F.col("o_orderkey")
        return self.table("orders").select(
            key.alias("deal_key"),
            F.col("o_custkey").alias("company_key"),
            F.col("o_orderpriority").alias("channel_key"),
            (F.col("o_custkey") % 3).cast("int").alias("source_key"),
            F.when(won, 6).when(F.col("o_orderstatus") == "P", 2 + key % 3).otherwise(1 + key % 5).cast("int").alias("stage_order"),
            (key % 7).cast("int").alias("lost_reason_key"),
            F.to_date("o_orderdate").alias("created_date"),
            won.cast("int").alias("is_won"),
            (F.col("o_orderstatus") == "P").cast("int").alias("is_lost"),
            F.when(won, F.col("o_totalprice").cast(MONEY)).otherwise(F.lit(0).cast(MONEY)).alias("mrr_usd"),
            F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), (key % 40).cast("double") / 4)
            .otherwise(0.0).alias("dialer_hours"),
        )

    def deal_lines(self) -> DataFrame:
        """Order lines collapsed to one row per deal."""
        lines = self.table("lineitem").select(
            F.col("l_orderkey").alias("deal_key"), "l_suppkey", "l_returnflag", F.to_date("l_shipdate").alias("ship"))
        return collapse_to_grain(lines, "deal_key", [
            F.min("l_suppkey").alias("rep_key"),
            F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("any_returned"),
            F.min("ship").alias("first_ship"), F.max("ship").alias("last_ship"),
        ])

    def deals_wide(self) -> DataFrame:
        """Deals with rep, cycle length and retention (one shuffle of the lines by deal key)."""
        d = self.deals().join(self.deal_lines(), "deal_key", "left")
        cycle = F.datediff("last_ship", "created_date")
        months = F.least(F.lit(12), F.floor(F.greatest(F.coalesce(cycle, F.lit(0)), F.lit(0)) / 30)).cast("int")
        churned = (F.col("is_won") == 1) & (months < 12)
        return d.withColumns({
            "deal_age_days": F.when(cycle >= 0, cycle),
            "retained_months": F.when(F.col("is_won") == 1, months),
            "is_churned": churned.cast("int"),
            "churned_mrr": F.when(churned, F.col("mrr_usd")).otherwise(F.lit(0).cast(MONEY)),
        }).drop("any_returned", "first_ship", "last_ship")

    def meetings(self) -> DataFrame:
        """One meeting per deal that has lines."""
        d = self.deals().select("deal_key", "company_key", "channel_key", "created_date")
        m = d.join(self.deal_lines(), "deal_key")
        first, last = F.datediff("first_ship", "created_date"), F.datediff("last_ship", "created_date")
        return m.select(
            "deal_key", "company_key", "channel_key", "rep_key",
            F.col("first_ship").alias("meeting_date"),
            F.when(F.col("any_returned") == 1, "Cancelled").otherwise("Held").alias("meeting_status"),
            F.when(first >= 0, first).alias("days_from_create"),
            F.when(last >= 0, last).alias("days_to_close"),
        )

    # -- outreach -------------------------------------------------------------------------------
    def calls(self) -> DataFrame:
        e = self.table("events")
        return e.select(
            F.col("event_id").alias("call_key"), F.col("user_id").alias("company_key"), F.col("user_id").alias("rep_key"),
            F.to_date("ts").alias("call_date"), F.col("event_type").alias("call_outcome"),
            F.col("event_type").isin("click", "signup", "purchase").cast("int").alias("is_connected"),
            (F.col("event_type") == "signup").cast("int").alias("is_meeting_booked"),
        )

    def touches(self) -> DataFrame:
        e = self.table("events")
        return e.select(
            F.col("event_id").alias("touch_key"), F.col("user_id").alias("company_key"),
            F.col("event_type").alias("channel_key"), F.col("ts").alias("touch_ts"),
            F.col("value").cast(MONEY).alias("minutes"), (F.col("event_type") == "purchase").cast("int").alias("led_to_deal"))

    # -- invoices -------------------------------------------------------------------------------
    def amounts(self) -> DataFrame:
        """Invoice lines with their amounts only: no join."""
        amount = (F.col("l_extendedprice").cast(MONEY) * (F.lit(1).cast(MONEY) - F.col("l_discount").cast(MONEY))).cast("decimal(18,4)")
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("invoice_no"), F.col("l_linenumber").alias("line_id"),
            F.to_date("l_shipdate").alias("invoice_date"), "l_partkey", F.col("l_quantity").cast(MONEY).alias("quantity"),
            amount.alias("amount_expected"),
            F.when(F.col("l_linestatus") == "F", amount).otherwise(F.lit(0).cast("decimal(18,4)")).alias("amount_confirmed"),
            (F.col("l_returnflag") != "N").alias("is_core"))

    def lines(self) -> DataFrame:
        """Invoice lines with product, bucket and cost."""
        p = self.table("part").select(
            F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("product_key"), F.col("p_type").alias("bucket_key"),
            F.col("p_retailprice").cast(MONEY).alias("unit_cost"))
        cost = (F.col("quantity") * F.col("unit_cost")).cast("decimal(18,4)")
        return self.amounts().join(p, "l_partkey").withColumn("cost", cost).drop("l_partkey", "quantity", "unit_cost")

    def _with_customer(self, lines: DataFrame) -> DataFrame:
        o = self.table("orders").select(
            F.col("o_orderkey").alias("invoice_no"), F.col("o_custkey").alias("customer_key"),
            F.to_date("o_orderdate").alias("recognition_date"))
        return lines.join(o, "invoice_no")

    def customer_lines(self) -> DataFrame:
        """Invoice lines with customer and recognition date (adds the order join)."""
        return self._with_customer(self.lines())

    def customer_amounts(self) -> DataFrame:
        return self._with_customer(self.amounts())

    # -- planning -------------------------------------------------------------------------------
    def params(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("product_key"), F.col("p_name").alias("variety_name"),
            (F.col("p_size") > 2).alias("active"),
            F.lit(100).cast(MONEY).alias("red_threshold"),
            F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast(MONEY)).alias("safety_floor"),
            (F.col("p_size") % 5).cast(MONEY).alias("safety_months"))

    def forecast(self) -> DataFrame:
        return (
            self.table("lineitem")
            .groupBy(F.col("l_partkey").alias("product_key"), F.year("l_shipdate").cast("string").alias("sales_year"),
                     F.col("l_returnflag").alias("channel"))
            .agg(F.sum(F.col("l_quantity").cast(MONEY)).cast(MONEY).alias("qty"))
        )

    def stock(self) -> DataFrame:
        """Dated stock counts: finished lines, with what orders rows of one day."""
        return self.table("lineitem").filter("l_linestatus = 'F'").select(
            F.col("l_partkey").alias("product_key"), F.to_date("l_shipdate").alias("as_of_date"),
            F.col("l_quantity").cast(MONEY).alias("qty"),
            "l_orderkey", "l_linenumber", "l_extendedprice")

    def incoming(self) -> DataFrame:
        """Open lines that arrive from the cut-off on."""
        open_lines = self.table("lineitem").filter((F.col("l_linestatus") == "O") & (F.col("l_shipdate") >= F.lit(ARRIVALS_FROM)))
        return open_lines.select(
            F.col("l_partkey").alias("product_key"), F.to_date("l_shipdate").alias("arrival_date"),
            F.col("l_quantity").cast(MONEY).alias("qty"))

    # -- signals, text, models -------------------------------------------------------------------
    def mentions(self) -> DataFrame:
        kind = F.col("event_type")
        return self.table("events").select(
            F.col("event_id").alias("mention_id"), F.col("user_id").alias("entity"), kind.alias("source"),
            F.when(kind.isin("view", "click"), "market").when(kind.isin("signup", "purchase"), "deal").otherwise("risk").alias("bucket"),
            F.when(kind == "error", "niche").otherwise("mainstream").alias("tier"),
            F.when(kind == "error", "CN").when(kind.isin("signup", "purchase"), "EU").otherwise("US").alias("region"),
            "ts", F.to_date("ts").alias("day"), F.col("value").cast(MONEY).alias("value"))

    def entity_flags(self) -> DataFrame:
        """One row per user with six 0/1 signals from the event feed, in one aggregation."""
        kind = F.col("event_type")
        g = self.table("events").groupBy(F.col("user_id").alias("entity_id")).agg(
            *[F.count_if(kind == k).alias(f"_{k}") for k in ("view", "click", "signup", "purchase", "error")],
            F.max("value").alias("_top"))
        flags = {
            "has_views": F.col("_view") >= 15, "has_clicks": F.col("_click") >= 15, "has_signups": F.col("_signup") >= 12,
            "has_purchases": F.col("_purchase") >= 15, "has_errors": F.col("_error") >= 14, "has_large_value": F.col("_top") >= 40,
        }
        return g.select("entity_id", *[c.cast("int").alias(n) for n, c in flags.items()])

    def documents(self) -> DataFrame:
        return self.table("documents")

    def scored(self) -> DataFrame:
        """Labelled documents with a deterministic score in [0, 1)."""
        d = self.table("documents").select("doc_id", "lang", "source", "n_chars")
        s = self.table("labels").select("doc_id", F.col("quality").alias("label")).join(d, "doc_id")
        score = ((F.col("n_chars") * 37 + F.col("doc_id") * 11) % 1000).cast("double") / 1000
        return s.withColumn("score", score)
