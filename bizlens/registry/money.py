"""Finance and planning queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from bizlens.functions.dates import date_key
from bizlens.operators import joins, quality
from bizlens.plans import finance, planning
from bizlens.registry.base_sql import dbl, pct, sql
from bizlens.registry.common import q
from bizlens.session import scratch_path
from bizlens.sources import readers, sinks
from bizlens.sources.revenue import RevenueRules, build_revenue_fact
from bizlens.sources.warehouse import AS_OF, Warehouse

STOCK_ORDER = ("as_of_date", "l_orderkey", "l_linenumber", "l_extendedprice")
YEAR = "2000"
UPLIFTS = planning.uplift_grid()


def _plan(w: Warehouse, **kw):
    return planning.production_plan(w.params(), w.forecast(), w.stock(), w.incoming(), year=YEAR, stock_order=STOCK_ORDER, **kw)


def _uneven_forecast(w: Warehouse):
    """The forecast with one more for every tenth product, so some channel sums match the plan and some do not."""
    more = F.when(F.col("product_key") % 10 == 1, 1).otherwise(0)
    return w.forecast().withColumn("qty", F.col("qty") + more)


def _snapshots(w: Warehouse, days=(dt.date(2001, 1, 1), dt.date(2001, 2, 1))):
    """Two commits of the plan: as it is, then with higher sales."""
    path = scratch_path(w.spark, "snapshots")
    plan = _plan(w).drop("red_threshold")
    sinks.commit_snapshot(plan, path, by="planner", as_of=days[0])
    moved = plan.withColumn("expected_sales", F.col("expected_sales") + 10).withColumn(
        "production_need", F.round(F.greatest(F.col("expected_sales") - F.col("stock_on_hand") - F.col("incoming"), F.lit(0.0)), 4))
    sinks.commit_snapshot(moved, path, by="planner", as_of=days[1])
    return sinks.read_snapshots(w.spark, path)


def _upserted(w: Warehouse):
    counts = w.stock().groupBy("product_key", "as_of_date").agg(F.sum("qty").cast("double").alias("qty"))
    fresh = counts.filter(F.dayofmonth("as_of_date") == 1).withColumn("qty", F.col("qty") + 1)
    return sinks.upsert(counts, fresh, ["product_key", "as_of_date"])


def _refreshed(w: Warehouse):
    path = scratch_path(w.spark, "refresh")
    yearly = w.forecast().withColumn("qty", F.col("qty").cast("double"))
    sinks.refresh(yearly, path, ["sales_year"])
    sinks.refresh(yearly.filter("sales_year = '2000'"), path, ["sales_year"])
    g = w.spark.read.parquet(path).groupBy(F.col("sales_year").cast("string").alias("sales_year"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum("qty").alias("qty"))


LEDGER_TAX = 0.08


def _reconciled(w: Warehouse):
    raw = w.table("lineitem").select(
        F.year("l_shipdate").alias("year"), "l_tax", "l_linenumber",
        (F.col("l_extendedprice").cast("decimal(18,2)") * (F.lit(1).cast("decimal(18,2)") - F.col("l_discount").cast("decimal(18,2)"))).cast("decimal(18,4)").alias("amount"))
    ledger = raw.filter(F.col("l_tax") != LEDGER_TAX).select("year", "amount")
    explained = raw.filter((F.col("l_tax") == LEDGER_TAX) & (F.col("l_linenumber") <= 6)).select("year", (-F.col("amount")).alias("amount"))
    return finance.reconcile(w.lines(), ledger, explained, 2000)


def _csv_round_trip(w: Warehouse):
    """Write deals as CSV, read them back against a contract with a coerced column, and sum them."""
    path = scratch_path(w.spark, "csv")
    deals = w.deals().select("deal_key", "channel_key", date_key("created_date").alias("created_key"), "mrr_usd", F.when(F.col("is_won") == 1, "12").otherwise("NA").alias("months"))
    sinks.write_table(deals, path, fmt="csv")
    contract = T.StructType().add("deal_key", "long").add("channel_key", "string").add("created_key", "integer").add("mrr_usd", "decimal(18,2)").add("months", "integer")
    back = readers.read_table(w.spark, path, contract, coerce=["months"], date_keys=["created_key"])
    return back.groupBy("channel_key").agg(
        F.count(F.lit(1)).alias("deals"), F.sum("mrr_usd").cast("double").alias("mrr"), F.count("months").alias("with_months"), F.min("created_key").alias("first_key"))


def _staged_revenue(w: Warehouse):
    """Staged lines to the canonical fact: bucket, core flag, confirmed amount."""
    staged = w.table("lineitem").select(
        F.col("l_returnflag").alias("kind"), F.when(F.col("l_linestatus") == "F", "Paid").otherwise("open").alias("payment_state"),
        F.col("l_extendedprice").cast("decimal(18,4)").alias("amount_expected"), F.col("l_quantity").cast("decimal(18,4)").alias("cost"))
    rules = RevenueRules({"Product": ["A", "R"], "Licence": ["X"]}, columns={"kind": "line_class"})
    g = build_revenue_fact(staged, rules).groupBy("bucket_key", "is_core")
    return g.agg(*[F.sum(c).cast("double").alias(c) for c in ("amount_expected", "amount_confirmed", "cost")])


PLAN_SQL = """, sales AS (SELECT product_key, sales_year, CAST(sum(qty) AS DOUBLE) AS expected_sales FROM forecast WHERE sales_year = '2000' GROUP BY ALL),
        st AS (SELECT product_key, CAST(qty AS DOUBLE) AS stock_on_hand FROM stock QUALIFY row_number() OVER (PARTITION BY product_key ORDER BY as_of_date DESC, l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC) = 1),
        inc AS (SELECT product_key, CAST(sum(qty) AS DOUBLE) AS incoming FROM incoming GROUP BY 1),
        b AS (SELECT p.product_key, variety_name, active, sales_year, coalesce(expected_sales, 0) AS expected_sales, coalesce(stock_on_hand, 0) AS stock_on_hand, coalesce(inc.incoming, 0) AS incoming,
                     CAST(red_threshold AS DOUBLE) AS red_threshold, {safety} AS safety
              FROM params p LEFT JOIN sales s ON s.product_key = p.product_key LEFT JOIN st ON st.product_key = p.product_key LEFT JOIN inc ON inc.product_key = p.product_key {where}),
        plan AS (SELECT product_key, variety_name, sales_year, expected_sales, stock_on_hand, incoming,
                        round(greatest(safety + expected_sales - stock_on_hand - incoming, 0), 4) AS production_need, round(stock_on_hand + incoming - expected_sales, 4) AS ending_stock,
                        CASE WHEN NOT active THEN 'stopped' WHEN round(stock_on_hand + incoming - expected_sales, 4) < red_threshold THEN 'red' ELSE 'green' END AS status, red_threshold FROM b)"""
CODED = "coalesce(greatest(CAST(safety_floor AS DOUBLE), 0), 0)"
DOCUMENTED = "coalesce(greatest(greatest(CAST(safety_floor AS DOUBLE), 0), CAST(safety_months AS DOUBLE) * coalesce(expected_sales, 0) / 12), 0)"


def plan_sql(body: str, safety: str = CODED, where: str = "WHERE active") -> str:
    return sql("params forecast stock incoming", PLAN_SQL.format(safety=safety, where=where) + " " + body)


AR = """, ar AS (SELECT customer_key, o, date_diff('day', invoice_date, DATE '2001-11-05') AS a
        FROM (SELECT *, amount_expected - amount_confirmed AS o FROM customer_lines) WHERE o > 0)"""
BUCKETS = f"""{dbl('sum(o)')} AS outstanding, coalesce({dbl('sum(o) FILTER (WHERE a BETWEEN 0 AND 30)')}, 0) AS bucket_0_30, coalesce({dbl('sum(o) FILTER (WHERE a BETWEEN 31 AND 60)')}, 0) AS bucket_31_60,
        coalesce({dbl('sum(o) FILTER (WHERE a BETWEEN 61 AND 90)')}, 0) AS bucket_61_90, coalesce({dbl('sum(o) FILTER (WHERE a > 90)')}, 0) AS bucket_90_plus"""

QUERIES = {
    # -- finance ----------------------------------------------------------------------------------
    "finance_headline": (q(lambda w: finance.headline(w.lines())), sql("lines", f"""
        SELECT {dbl('sum(amount_expected)')} AS revenue_expected, {dbl('sum(amount_confirmed)')} AS revenue_confirmed, {dbl('sum(amount_expected - amount_confirmed)')} AS outstanding,
               {dbl('sum(cost)')} AS cogs, {dbl('sum(amount_expected - cost)')} AS contribution FROM lines""")),
    "finance_overview": (q(lambda w: finance.overview(w.lines())), sql("lines", f"""
        SELECT {dbl('sum(amount_expected)')} AS revenue_expected, {dbl('sum(amount_confirmed)')} AS revenue_confirmed, {dbl('sum(amount_expected - amount_confirmed)')} AS outstanding,
               {dbl('sum(cost)')} AS cogs, {dbl('sum(amount_expected - cost)')} AS contribution, {pct('sum(amount_expected - cost)', 'sum(amount_expected)', 1)} AS margin_pct FROM lines""")),
    "revenue_by_month": (q(lambda w: finance.revenue_by_month(w.amounts())), sql("amounts", f"""
        SELECT CAST(date_trunc('month', invoice_date) AS DATE) AS month, round({dbl('sum(amount_expected)')}, 2) AS revenue FROM amounts GROUP BY 1""")),
    "margin_by_product": (q(lambda w: finance.margin_by_product(w.lines())), sql("lines", f"""
        SELECT product_key, {dbl('sum(amount_expected)')} AS revenue, {dbl('sum(cost)')} AS cogs, {pct('sum(amount_expected - cost)', 'sum(amount_expected)', 1)} AS contribution_margin_pct
        FROM lines WHERE is_core GROUP BY 1""")),
    "thin_margin": (q(lambda w: finance.thin_margin(finance.margin_by_product(w.lines()), 10.0, 15.0)), sql("lines", f"""
        SELECT *, contribution_margin_pct < 10 AS is_thin, CASE WHEN contribution_margin_pct < 10 THEN 'red' WHEN contribution_margin_pct >= 15 THEN 'green' WHEN contribution_margin_pct IS NOT NULL THEN 'amber' END AS colour
        FROM (SELECT product_key, {dbl('sum(amount_expected)')} AS revenue, {dbl('sum(cost)')} AS cogs, {pct('sum(amount_expected - cost)', 'sum(amount_expected)', 1)} AS contribution_margin_pct FROM lines WHERE is_core GROUP BY 1)""")),
    "customer_profit": (q(lambda w: finance.customer_profit(w.customer_lines())), sql("customer_lines", f"""
        SELECT *, revenue_rank - contribution_rank AS rank_delta FROM (
            SELECT *, CAST(rank() OVER (ORDER BY revenue DESC) AS INTEGER) AS revenue_rank, CAST(rank() OVER (ORDER BY contribution DESC) AS INTEGER) AS contribution_rank FROM (
                SELECT customer_key, {dbl('sum(amount_expected)')} AS revenue, {dbl('sum(amount_expected - cost)')} AS contribution FROM customer_lines GROUP BY 1))""")),
    "contribution_concentration": (q(lambda w: finance.contribution_concentration(w.customer_lines())), sql("customer_lines", f"""
        SELECT step * 10.0::DOUBLE AS top_pct, {pct('max_by(cum, pos)', 'any_value(total)')} AS cum_share_pct FROM (
            SELECT CAST(ceil(CAST(pos AS DOUBLE) * 10 / n) AS INTEGER) AS step, * FROM (
                SELECT row_number() OVER w AS pos, sum(v) OVER w AS cum, count(*) OVER () AS n, sum(v) OVER () AS total
                FROM (SELECT customer_key, sum(amount_expected - cost) AS v FROM customer_lines GROUP BY 1)
                WINDOW w AS (ORDER BY v DESC, customer_key ROWS UNBOUNDED PRECEDING))) GROUP BY step""")),
    "receivables": (q(lambda w: finance.receivables(w.customer_amounts(), AS_OF)), sql("customer_amounts", AR.replace("customer_lines", "customer_amounts") + f" SELECT customer_key, {BUCKETS} FROM ar GROUP BY 1")),
    "ageing_total": (q(lambda w: finance.ageing_total(w.amounts(), AS_OF)), sql("customer_amounts", AR.replace("customer_lines", "customer_amounts") + f" SELECT {BUCKETS} FROM ar")),
    "collection_list": (q(lambda w: finance.collection_list(finance.receivables(w.customer_amounts(), AS_OF))), sql("customer_amounts", AR.replace("customer_lines", "customer_amounts") + f"""
        SELECT customer_key, outstanding, bucket_90_plus FROM (SELECT customer_key, {BUCKETS} FROM ar GROUP BY 1) ORDER BY outstanding DESC, customer_key LIMIT 10""")),
    "revenue_confirmed_by_year": (q(lambda w: finance.revenue(w.amounts(), "Confirmed", "year")), sql("amounts", f"""
        SELECT CAST(year(invoice_date) AS INTEGER) AS year, round({dbl('sum(amount_confirmed)')}, 2) AS revenue, 'Confirmed' AS basis FROM amounts GROUP BY 1""")),
    "revenue_recognized_by_month": (q(lambda w: finance.revenue(w.customer_amounts(), "Recognized", "month")), sql("customer_amounts", f"""
        SELECT CAST(date_trunc('month', recognition_date) AS DATE) AS month, round({dbl('sum(amount_expected)')}, 2) AS revenue, 'Recognized' AS basis FROM customer_amounts GROUP BY 1""")),
    "core_margin": (q(lambda w: finance.core_margin(w.lines())), sql("lines", f"""
        SELECT {pct('sum(amount_expected - cost)', 'sum(amount_expected)')} AS core_margin_pct FROM lines WHERE is_core""")),
    "ledger_reconcile": (q(_reconciled), sql("amounts", """
        , r AS (SELECT year(l_shipdate) AS y, l_tax, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (CAST(1 AS DECIMAL(18,2)) - CAST(l_discount AS DECIMAL(18,2))) AS DECIMAL(18,4)) AS amount FROM lineitem),
        v AS (SELECT (SELECT CAST(sum(amount_expected) AS DOUBLE) FROM amounts WHERE year(invoice_date) = 2000) AS invoiced, (SELECT CAST(sum(amount) AS DOUBLE) FROM r WHERE y = 2000 AND l_tax <> 0.08) AS ledger,
                     (SELECT CAST(sum(-amount) AS DOUBLE) FROM r WHERE y = 2000 AND l_tax = 0.08 AND l_linenumber <= 6) AS explained)
        SELECT *, round(abs(unexplained) / abs(ledger), 8) AS unexplained_share, round(abs(unexplained) / abs(ledger), 8) <= 0.005 AS passed
        FROM (SELECT *, round(ledger - invoiced, 4) AS residual, round((ledger - invoiced) - explained, 4) AS unexplained FROM v)""".strip())),
    # -- planning ---------------------------------------------------------------------------------
    "production_plan": (q(_plan), plan_sql("SELECT * FROM plan")),
    "production_plan_documented": (q(lambda w: _plan(w, safety_mode="documented", include_stopped=True)), plan_sql("SELECT * FROM plan", DOCUMENTED, "")),
    "plan_headline": (q(lambda w: planning.headline(_plan(w))), plan_sql("""
        SELECT round(CAST(sum(CAST(production_need AS DECIMAL(18,4))) AS DOUBLE), 0) AS total_to_produce, count(*) FILTER (WHERE status = 'red') AS varieties_red,
               count(*) FILTER (WHERE production_need > 0) AS varieties_needing_production, count(*) AS rows_active FROM plan""")),
    "plan_channel_mismatches": (q(lambda w: planning.channel_mismatches(_plan(w), _uneven_forecast(w))), plan_sql("""
        SELECT p.product_key, p.sales_year, p.expected_sales, CAST(coalesce(sum(f.qty), 0) AS DOUBLE) AS channel_sum FROM plan p
        LEFT JOIN (SELECT * REPLACE (CASE WHEN product_key % 10 = 1 THEN qty + 1 ELSE qty END AS qty) FROM forecast) f ON f.product_key = p.product_key AND f.sales_year = p.sales_year WHERE p.sales_year IS NOT NULL GROUP BY ALL HAVING abs(p.expected_sales - coalesce(sum(f.qty), 0)) > 0.05""")),
    "plan_at_risk": (q(lambda w: planning.at_risk(_plan(w))), plan_sql("""
        SELECT *, CASE WHEN production_need > 0 THEN 'produce now' ELSE 'watch' END AS action, round(red_threshold - ending_stock, 4) AS below_line FROM plan WHERE status = 'red'""")),
    "plan_what_if": (q(lambda w: planning.what_if(_plan(w), UPLIFTS, capacity=5000)), plan_sql(f"""
        SELECT u AS uplift, round(CAST(sum(CAST(expected_sales * (1.0::DOUBLE + u) - stock_on_hand - incoming AS DECIMAL(18,4))) AS DOUBLE), 2) AS production_need,
               greatest(round(round(CAST(sum(CAST(expected_sales * (1.0::DOUBLE + u) - stock_on_hand - incoming AS DECIMAL(18,4))) AS DOUBLE), 2) - 5000, 2), 0) AS shortfall
        FROM plan, (SELECT CAST(unnest({UPLIFTS}) AS DOUBLE) AS u) GROUP BY u""")),
    "plan_what_if_floored": (q(lambda w: planning.what_if(_plan(w), [-0.2, 0.0, 0.5], stock_shock=-0.1, floor=True)), plan_sql("""
        SELECT u AS uplift, round(CAST(sum(CAST(greatest(expected_sales * (1.0::DOUBLE + u) - stock_on_hand * (1.0::DOUBLE - 0.1::DOUBLE) - incoming, 0) AS DECIMAL(18,4))) AS DOUBLE), 2) AS production_need
        FROM plan, (SELECT CAST(unnest([-0.2, 0.0, 0.5]) AS DOUBLE) AS u) GROUP BY u""")),
    "plan_scenario_rows": (q(lambda w: joins.scenario_grid(_plan(w).select("product_key", "expected_sales"), [-0.25, 0.0, 0.25], "uplift").withColumn("scenario_sales", F.col("expected_sales") * (1 + F.col("uplift")))), plan_sql("""
        SELECT product_key, expected_sales, u AS uplift, expected_sales * (1 + u) AS scenario_sales FROM plan, (SELECT CAST(unnest([-0.25, 0.0, 0.25]) AS DOUBLE) AS u)""")),
    "plan_lot_size": (q(lambda w: planning.start_by(planning.lot_size(_plan(w)), F.make_date(F.col("sales_year").cast("int"), F.lit(8), F.lit(1))).select("product_key", "production_need", "plan_target", "lot_gap", "start_by")), plan_sql("""
        SELECT product_key, production_need, plan_target, round(plan_target - production_need, 4) AS lot_gap, CAST(make_date(CAST(sales_year AS BIGINT), 8, 1) - INTERVAL 12 MONTH AS DATE) AS start_by
        FROM (SELECT *, CAST(greatest((floor(production_need / 50) + 1) * 50, 150) AS BIGINT) AS plan_target FROM plan WHERE production_need > 0)""")),
    "plan_roll_forward": (q(lambda w: planning.roll_forward(w.params(), w.forecast(), w.stock(), w.incoming(), STOCK_ORDER)), plan_sql("""
        , f AS (SELECT product_key, sales_year, CAST(sum(qty) AS DOUBLE) AS sales FROM forecast GROUP BY ALL),
        i AS (SELECT product_key, CAST(year(arrival_date) AS VARCHAR) AS sales_year, CAST(sum(qty) AS DOUBLE) AS incoming FROM incoming GROUP BY ALL),
        d AS (SELECT coalesce(f.product_key, i.product_key) AS product_key, coalesce(f.sales_year, i.sales_year) AS sales_year, coalesce(sales, 0) AS sales, coalesce(i.incoming, 0) AS incoming
              FROM f FULL JOIN i ON f.product_key = i.product_key AND f.sales_year = i.sales_year),
        l AS (SELECT d.*, b.safety, b.stock_on_hand + sum(d.incoming - d.sales) OVER (PARTITION BY d.product_key ORDER BY d.sales_year) AS lvl FROM d JOIN b ON b.product_key = d.product_key),
        c AS (SELECT *, greatest(max(safety - lvl) OVER (PARTITION BY product_key ORDER BY sales_year), 0) AS cum FROM l)
        SELECT product_key, sales_year, sales, incoming, round(cum - coalesce(lag(cum) OVER (PARTITION BY product_key ORDER BY sales_year), 0), 4) AS production_need, round(lvl + cum, 4) AS ending_stock FROM c""")),
    "plan_snapshot_history": (q(lambda w: planning.history(_snapshots(w))), plan_sql("""
        , s AS (SELECT product_key, sales_year, DATE '2001-01-01' AS snapshot_date, expected_sales, ending_stock, production_need, status FROM plan
               UNION ALL SELECT product_key, sales_year, DATE '2001-02-01', expected_sales + 10, ending_stock, round(greatest(expected_sales + 10 - stock_on_hand - incoming, 0), 4), status FROM plan)
        SELECT *, round(production_need - lag(production_need) OVER (PARTITION BY product_key, sales_year ORDER BY snapshot_date), 4) AS need_change FROM s""")),
    "plan_vs_actual": (q(lambda w: planning.plan_vs_actual(_snapshots(w).filter("sales_year is not null"), w.forecast().filter("channel <> 'R'"))), plan_sql("""
        SELECT p.product_key, p.sales_year, expected_sales + 10 AS expected_sales, coalesce(a, 0) AS actual_sales, round(coalesce(a, 0) - (expected_sales + 10), 4) AS variance
        FROM plan p LEFT JOIN (SELECT product_key, sales_year, CAST(sum(qty) AS DOUBLE) AS a FROM forecast WHERE channel <> 'R' GROUP BY ALL) x ON x.product_key = p.product_key AND x.sales_year = p.sales_year WHERE p.sales_year IS NOT NULL""")),
    "stock_upsert": (q(_upserted), sql("stock", """
        SELECT product_key, as_of_date, q + CASE WHEN day(as_of_date) = 1 THEN 1 ELSE 0 END AS qty FROM (SELECT product_key, as_of_date, CAST(sum(qty) AS DOUBLE) AS q FROM stock GROUP BY ALL)""")),
    "partition_refresh": (q(_refreshed), sql("forecast", """
        SELECT sales_year, count(*) AS n, CAST(sum(qty) AS DOUBLE) AS qty FROM forecast GROUP BY 1""")),
    # -- sources ----------------------------------------------------------------------------------
    "csv_round_trip": (q(_csv_round_trip), sql("deals", """
        SELECT channel_key, count(*) AS deals, CAST(sum(mrr_usd) AS DOUBLE) AS mrr, count(*) FILTER (WHERE is_won = 1) AS with_months, min(CAST(strftime(created_date, '%Y%m%d') AS INTEGER)) AS first_key FROM deals GROUP BY 1""")),
    "staged_revenue": (q(_staged_revenue), """
        SELECT CASE WHEN l_returnflag IN ('A', 'R') THEN 'Product' ELSE 'Other' END AS bucket_key, l_returnflag IN ('A', 'R') AS is_core, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS amount_expected,
               CAST(sum(CASE WHEN l_linestatus = 'F' THEN CAST(l_extendedprice AS DECIMAL(18,4)) ELSE 0 END) AS DOUBLE) AS amount_confirmed,
               CAST(sum(CASE WHEN l_returnflag IN ('A', 'R') THEN CAST(l_quantity AS DECIMAL(18,4)) ELSE 0 END) AS DOUBLE) AS cost FROM lineitem GROUP BY ALL"""),
    "plan_key_gate": (q(lambda w: quality.pk_violations(w.forecast(), ["product_key", "sales_year"])), sql("forecast", """
        SELECT product_key, sales_year, count(*) AS copies FROM forecast GROUP BY ALL HAVING count(*) > 1""")),
}
