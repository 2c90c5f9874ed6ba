"""Invoice-line finance: margin, profitability, receivables, ledger gate."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlens.functions.bands import rag
from bizlens.functions.dates import age_days, month_start
from bizlens.functions.metrics import ratio, rate
from bizlens.operators import ordering
from bizlens.operators.aggregate import one_row
from bizlens.operators.ordering import rank_by, top_k

EXACT = "decimal(18,4)"


def _total(c: str | Column, where: Column | None = None) -> Column:
    """Exact sum of an amount, as a double."""
    v = (F.col(c) if isinstance(c, str) else c).cast(EXACT)
    return F.sum(v if where is None else F.when(where, v)).cast("double")


def _open() -> Column:
    return F.col("amount_expected").cast(EXACT) - F.col("amount_confirmed").cast(EXACT)


def _margin() -> Column:
    return F.col("amount_expected").cast(EXACT) - F.col("cost").cast(EXACT)


def headline(lines: DataFrame) -> DataFrame:
    return lines.agg(
        _total("amount_expected").alias("revenue_expected"), _total("amount_confirmed").alias("revenue_confirmed"),
        _total(_open()).alias("outstanding"), _total("cost").alias("cogs"), _total(_margin()).alias("contribution"))


def overview(lines: DataFrame) -> DataFrame:
    """Headline with the contribution margin."""
    return headline(lines).withColumn("margin_pct", rate("contribution", "revenue_expected", digits=1))


def revenue_by_month(lines: DataFrame, date: str = "invoice_date") -> DataFrame:
    return lines.groupBy(month_start(date).alias("month")).agg(F.round(_total("amount_expected"), 2).alias("revenue"))


def margin_by_product(lines: DataFrame) -> DataFrame:
    """Contribution margin per product on core lines only."""
    g = lines.filter("is_core").groupBy("product_key").agg(
        _total("amount_expected").alias("revenue"), _total("cost").alias("cogs"), _total(_margin()).alias("contribution"))
    return g.select("product_key", "revenue", "cogs", rate("contribution", "revenue", digits=1).alias("contribution_margin_pct"))


def thin_margin(margins: DataFrame, threshold: float = 70.0, good: float | None = None) -> DataFrame:
    """Flag and colour products below the margin line."""
    m = F.col("contribution_margin_pct")
    return margins.withColumns({
        "is_thin": m < F.lit(threshold), "colour": rag(m, threshold, threshold if good is None else good)})


def customer_profit(lines: DataFrame) -> DataFrame:
    """Revenue and contribution per customer with both ranks and their difference."""
    g = lines.groupBy("customer_key").agg(
        _total("amount_expected").alias("revenue"), _total(_margin()).alias("contribution"))
    ranked = rank_by(g, {"revenue_rank": "revenue", "contribution_rank": "contribution"})
    return ranked.withColumn("rank_delta", F.col("revenue_rank") - F.col("contribution_rank"))


def contribution_concentration(lines: DataFrame, steps: int = 10) -> DataFrame:
    """Top x percent of customers against their share of contribution."""
    g = lines.groupBy("customer_key").agg(F.sum(_margin()).alias("contribution"))
    return ordering.concentration(g, "customer_key", "contribution", steps)


def receivables(lines: DataFrame, as_of: dt.date, by: Sequence[str] = ("customer_key",), not_due: bool = False) -> DataFrame:
    """Open amounts per customer in age buckets.

    Lines dated after ``as_of`` are open but in no bucket; ``not_due`` shows them in their own column.
    """
    age = age_days("invoice_date", as_of)
    due = lines.select(*by, _open().alias("_o"), age.alias("_a")).filter("_o > 0")

    def bucket(cond: Column) -> Column:
        return F.coalesce(_total("_o", cond), F.lit(0.0))

    aggs = [
        _total("_o").alias("outstanding"), bucket(F.col("_a").between(0, 30)).alias("bucket_0_30"),
        bucket(F.col("_a").between(31, 60)).alias("bucket_31_60"), bucket(F.col("_a").between(61, 90)).alias("bucket_61_90"),
        bucket(F.col("_a") > 90).alias("bucket_90_plus"),
    ]
    if not_due:
        aggs.append(bucket(F.col("_a") < 0).alias("bucket_not_due"))
    return due.groupBy(*by).agg(*aggs) if by else due.agg(*aggs)


def ageing_total(lines: DataFrame, as_of: dt.date) -> DataFrame:
    return receivables(lines, as_of, by=())


def collection_list(ar: DataFrame, k: int = 10) -> DataFrame:
    """Customers with the most open money."""
    return top_k(ar.select("customer_key", "outstanding", "bucket_90_plus"), [F.col("outstanding").desc(), F.col("customer_key")], k)


def revenue(lines: DataFrame, basis: str = "Expected", by: str | None = "year") -> DataFrame:
    """Revenue on the chosen basis; recognised revenue is dated by its recognition date."""
    amount = {"Expected": "amount_expected", "Confirmed": "amount_confirmed", "Recognized": "amount_expected"}[basis]
    dated = "recognition_date" if basis == "Recognized" else "invoice_date"
    total = F.round(_total(amount), 2).alias("revenue")
    if by is None:
        return lines.agg(total)
    key = {"year": F.year(dated), "month": month_start(dated)}.get(by, F.col(by))
    return lines.groupBy(key.alias(by)).agg(total).withColumn("basis", F.lit(basis))


def core_margin(lines: DataFrame) -> DataFrame:
    g = lines.filter("is_core").agg(_total("amount_expected").alias("revenue"), _total(_margin()).alias("contribution"))
    return g.select(rate("contribution", "revenue").alias("core_margin_pct"))


def reconcile(lines: DataFrame, ledger: DataFrame, reconciling: DataFrame, year: int, tol: float = 0.005) -> DataFrame:
    """Tie a year of invoices to the ledger.

    ``ledger`` and ``reconciling`` are inputs with ``year`` and ``amount``. What is left after the explained
    items, relative to the ledger, must not exceed ``tol``.
    """
    row = one_row([
        (lines.filter(F.year("invoice_date") == year), {"invoiced": _total("amount_expected")}),
        (ledger.filter(F.col("year") == year), {"ledger": _total("amount")}),
        (reconciling.filter(F.col("year") == year), {"explained": F.coalesce(_total("amount"), F.lit(0.0))}),
    ])
    residual = F.col("ledger") - F.coalesce("invoiced", F.lit(0.0))
    out = row.withColumn("residual", F.round(residual, 4)).withColumn("unexplained", F.round(residual - F.col("explained"), 4))
    out = out.withColumn("unexplained_share", F.round(ratio(F.abs("unexplained"), F.abs("ledger")), 8))
    return out.withColumn("passed", F.coalesce(F.col("unexplained_share") <= F.lit(tol), F.lit(False)))
