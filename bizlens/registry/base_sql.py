"""SQL twins of the logical tables, written independently of the Spark mapping."""

from __future__ import annotations

from bizlens.sources.warehouse import CHANNELS, LOST_REASONS, SOURCES, STAGES


def _values(rows: list[tuple]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(repr(v) for v in r) + ")" for r in rows)


CTES: dict[str, str] = {
    "dim_channel": f"dim_channel(channel_key, channel_name, channel_group, is_dialer_motion) AS ({_values(CHANNELS)})",
    "dim_source": f"dim_source(source_key, source_name) AS ({_values(SOURCES)})",
    "dim_stage": f"dim_stage(stage_order, stage_name) AS ({_values(STAGES)})",
    "dim_lost_reason": f"dim_lost_reason(lost_reason_key, lost_reason, reason_category) AS ({_values(LOST_REASONS)})",
    "company": """company AS (
        SELECT c_custkey AS company_key, c_name AS company_name, c_mktsegment AS industry, r_name AS region, n_name AS country,
               CASE WHEN c_acctbal >= 8000 THEN '500+' WHEN c_acctbal >= 6000 THEN '201-500' WHEN c_acctbal >= 4000 THEN '51-200'
                    WHEN c_acctbal >= 2000 THEN '21-50' WHEN c_acctbal >= 0 THEN '6-20' ELSE '1-5' END AS employee_band
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "rep": """rep AS (SELECT s_suppkey AS rep_key, s_name AS rep_name, 'team ' || CAST(s_nationkey AS VARCHAR) AS rep_team FROM supplier)""",
    "deal_lines": """deal_lines AS (
        SELECT l_orderkey AS deal_key, min(l_suppkey) AS rep_key, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS any_returned,
               min(CAST(l_shipdate AS DATE)) AS first_ship, max(CAST(l_shipdate AS DATE)) AS last_ship
        FROM lineitem GROUP BY l_orderkey)""",
    "deals": """deals AS (
        SELECT o_orderkey AS deal_key, o_custkey AS company_key, o_orderpriority AS channel_key, CAST(o_custkey % 3 AS INTEGER) AS source_key,
               CAST(CASE o_orderstatus WHEN 'F' THEN 6 WHEN 'P' THEN 2 + o_orderkey % 3 ELSE 1 + o_orderkey % 5 END AS INTEGER) AS stage_order,
               CAST(o_orderkey % 7 AS INTEGER) AS lost_reason_key, CAST(o_orderdate AS DATE) AS created_date,
               CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS is_won, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS is_lost,
               CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END AS mrr_usd,
               CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN CAST(o_orderkey % 40 AS DOUBLE) / 4 ELSE 0.0::DOUBLE END AS dialer_hours
        FROM orders)""",
    "deals_wide": """deals_wide AS (
        SELECT x.*, CASE WHEN is_churned = 1 THEN mrr_usd ELSE CAST(0 AS DECIMAL(18,2)) END AS churned_mrr FROM (
            SELECT y.*, CASE WHEN is_won = 1 AND months < 12 THEN 1 ELSE 0 END AS is_churned,
                   CASE WHEN is_won = 1 THEN months END AS retained_months FROM (
                SELECT d.*, l.rep_key, CASE WHEN date_diff('day', created_date, last_ship) >= 0 THEN date_diff('day', created_date, last_ship) END AS deal_age_days,
                       least(12, coalesce(greatest(date_diff('day', created_date, last_ship), 0), 0) // 30) AS months
                FROM deals d LEFT JOIN deal_lines l ON l.deal_key = d.deal_key) y) x)""",
    "meetings": """meetings AS (
        SELECT d.deal_key, company_key, channel_key, rep_key, first_ship AS meeting_date,
               CASE WHEN any_returned = 1 THEN 'Cancelled' ELSE 'Held' END AS meeting_status,
               CASE WHEN date_diff('day', created_date, first_ship) >= 0 THEN date_diff('day', created_date, first_ship) END AS days_from_create,
               CASE WHEN date_diff('day', created_date, last_ship) >= 0 THEN date_diff('day', created_date, last_ship) END AS days_to_close
        FROM deals d JOIN deal_lines l ON l.deal_key = d.deal_key)""",
    "calls": """calls AS (
        SELECT event_id AS call_key, user_id AS company_key, user_id AS rep_key, CAST(ts AS DATE) AS call_date, event_type AS call_outcome,
               CASE WHEN event_type IN ('click', 'signup', 'purchase') THEN 1 ELSE 0 END AS is_connected,
               CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS is_meeting_booked FROM events)""",
    "touches": """touches AS (
        SELECT event_id AS touch_key, user_id AS company_key, event_type AS channel_key, ts AS touch_ts, CAST(value AS DECIMAL(18,2)) AS minutes,
               CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS led_to_deal FROM events)""",
    "lines": """lines AS (
        SELECT l_orderkey AS invoice_no, l_linenumber AS line_id, CAST(l_shipdate AS DATE) AS invoice_date, p_brand AS product_key, p_type AS bucket_key,
               amt AS amount_expected, CASE WHEN l_linestatus = 'F' THEN amt ELSE CAST(0 AS DECIMAL(18,4)) END AS amount_confirmed,
               CAST(CAST(l_quantity AS DECIMAL(18,2)) * CAST(p_retailprice AS DECIMAL(18,2)) AS DECIMAL(18,4)) AS cost, l_returnflag <> 'N' AS is_core
        FROM (SELECT *, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (CAST(1 AS DECIMAL(18,2)) - CAST(l_discount AS DECIMAL(18,2))) AS DECIMAL(18,4)) AS amt FROM lineitem) l
        JOIN part ON p_partkey = l_partkey)""",
    "amounts": """amounts AS (
        SELECT l_orderkey AS invoice_no, CAST(l_shipdate AS DATE) AS invoice_date, amt AS amount_expected,
               CASE WHEN l_linestatus = 'F' THEN amt ELSE CAST(0 AS DECIMAL(18,4)) END AS amount_confirmed
        FROM (SELECT *, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (CAST(1 AS DECIMAL(18,2)) - CAST(l_discount AS DECIMAL(18,2))) AS DECIMAL(18,4)) AS amt FROM lineitem) l)""",
    "customer_amounts": """customer_amounts AS (
        SELECT amounts.*, o_custkey AS customer_key, CAST(o_orderdate AS DATE) AS recognition_date FROM amounts JOIN orders ON o_orderkey = invoice_no)""",
    "customer_lines": """customer_lines AS (
        SELECT lines.*, o_custkey AS customer_key, CAST(o_orderdate AS DATE) AS recognition_date FROM lines JOIN orders ON o_orderkey = invoice_no)""",
    "params": """params AS (
        SELECT p_partkey AS product_key, p_name AS variety_name, p_size > 2 AS active, CAST(100 AS DECIMAL(18,2)) AS red_threshold,
               CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS DECIMAL(18,2)) END AS safety_floor, CAST(p_size % 5 AS DECIMAL(18,2)) AS safety_months FROM part)""",
    "forecast": """forecast AS (
        SELECT l_partkey AS product_key, CAST(year(l_shipdate) AS VARCHAR) AS sales_year, l_returnflag AS channel,
               CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS qty FROM lineitem GROUP BY ALL)""",
    "stock": """stock AS (
        SELECT l_partkey AS product_key, CAST(l_shipdate AS DATE) AS as_of_date, CAST(l_quantity AS DECIMAL(18,2)) AS qty,
               l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_linestatus = 'F')""",
    "incoming": """incoming AS (
        SELECT l_partkey AS product_key, CAST(l_shipdate AS DATE) AS arrival_date, CAST(l_quantity AS DECIMAL(18,2)) AS qty FROM lineitem WHERE l_linestatus = 'O' AND l_shipdate >= TIMESTAMP '2001-01-01')""",
    "mentions": """mentions AS (
        SELECT event_id AS mention_id, user_id AS entity, event_type AS source,
               CASE WHEN event_type IN ('view', 'click') THEN 'market' WHEN event_type IN ('signup', 'purchase') THEN 'deal' ELSE 'risk' END AS bucket,
               CASE WHEN event_type = 'error' THEN 'niche' ELSE 'mainstream' END AS tier,
               CASE WHEN event_type = 'error' THEN 'CN' WHEN event_type IN ('signup', 'purchase') THEN 'EU' ELSE 'US' END AS region,
               ts, CAST(ts AS DATE) AS day, CAST(value AS DECIMAL(18,2)) AS value FROM events)""",
    "flags": """flags AS (
        SELECT user_id AS entity_id, CASE WHEN count(*) FILTER (WHERE event_type = 'view') >= 15 THEN 1 ELSE 0 END AS has_views, CASE WHEN count(*) FILTER (WHERE event_type = 'click') >= 15 THEN 1 ELSE 0 END AS has_clicks,
               CASE WHEN count(*) FILTER (WHERE event_type = 'signup') >= 12 THEN 1 ELSE 0 END AS has_signups, CASE WHEN count(*) FILTER (WHERE event_type = 'purchase') >= 15 THEN 1 ELSE 0 END AS has_purchases,
               CASE WHEN count(*) FILTER (WHERE event_type = 'error') >= 14 THEN 1 ELSE 0 END AS has_errors, CASE WHEN max(value) >= 40 THEN 1 ELSE 0 END AS has_large_value FROM events GROUP BY 1)""",
    "scored": """scored AS (
        SELECT d.doc_id, l.quality AS label, lang, source, n_chars, CAST((n_chars * 37 + d.doc_id * 11) % 1000 AS DOUBLE) / 1000 AS score
        FROM labels l JOIN documents d ON d.doc_id = l.doc_id)""",
}

NEEDS = {
    "deals_wide": ["deals", "deal_lines"],
    "meetings": ["deals", "deal_lines"],
    "customer_lines": ["lines"],
    "customer_amounts": ["amounts"],
}


def sql(names: str, body: str) -> str:
    """A statement over the named logical tables; a body may open with ``, x AS (...)``."""
    order: list[str] = []
    for name in names.split():
        for need in [*NEEDS.get(name, []), name]:
            if need not in order:
                order.append(need)
    return f"WITH {', '.join(CTES[n] for n in order)} {body}"


def pct(num: str, den: str, digits: int = 2) -> str:
    """Percentage of two SQL expressions, NULL on a zero denominator."""
    return f"round(100.0::DOUBLE * CAST({num} AS DOUBLE) / nullif(CAST({den} AS DOUBLE), 0), {digits})"


def dbl(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE)"


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"
