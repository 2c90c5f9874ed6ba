"""Production planning: the plan, its scenarios, lots, snapshots and the multi-year view."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bizlens.functions.bands import active_or_unknown
from bizlens.operators.joins import reconcile_sums
from bizlens.operators.ordering import latest_per_key

QTY = "decimal(18,4)"


def _sum_qty(df: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(F.col("qty").cast(QTY)).cast("double").alias(out))


def _safety(mode: str) -> Column:
    floor = F.greatest(F.col("safety_floor").cast("double"), F.lit(0.0))
    if mode == "as_coded":
        return F.coalesce(floor, F.lit(0.0))
    if mode == "documented":
        cover = F.col("safety_months").cast("double") * F.coalesce("expected_sales", F.lit(0.0)) / F.lit(12.0)
        return F.coalesce(F.greatest(floor, cover), F.lit(0.0))
    raise ValueError(f"unknown safety mode {mode!r}")


def latest_stock(stock: DataFrame, order: Sequence[str] = ("as_of_date",)) -> DataFrame:
    return latest_per_key(stock, ["product_key"], list(order), keep=["product_key", "qty"]).select(
        "product_key", F.col("qty").cast("double").alias("stock_on_hand"))


def production_plan(params: DataFrame, forecast: DataFrame, stock: DataFrame, incoming: DataFrame,
                    year: str | None = None, per_year: bool = True, safety_mode: str = "as_coded",
                    include_stopped: bool = False, stock_order: Sequence[str] = ("as_of_date",)) -> DataFrame:
    """Need, ending stock and status per product (and sales year).

    Every input is reduced to the product grain before it is joined, so all joins are one to one.
    ``per_year=False`` sums all forecast years into one row per product. Stopped products
    appear only with ``include_stopped``.
    """
    if year is not None:
        forecast = forecast.filter(F.col("sales_year") == year)
    keys = ["product_key", "sales_year"] if per_year else ["product_key"]
    products = params if include_stopped else params.filter(active_or_unknown("active"))
    joined = (
        products.join(_sum_qty(forecast, keys, "expected_sales"), "product_key", "left")
        .join(latest_stock(stock, stock_order), "product_key", "left")
        .join(_sum_qty(incoming, ["product_key"], "incoming"), "product_key", "left")
        .withColumn("safety", _safety(safety_mode))
    )
    filled = joined.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("expected_sales", "stock_on_hand", "incoming")})
    ending = F.col("stock_on_hand") + F.col("incoming") - F.col("expected_sales")
    need = F.greatest(F.col("safety") + F.col("expected_sales") - F.col("stock_on_hand") - F.col("incoming"), F.lit(0.0))
    status = (
        F.when(~active_or_unknown("active"), "stopped")
        .when(F.round(ending, 4) < F.col("red_threshold").cast("double"), "red").otherwise("green")
    )
    return filled.select(
        "product_key", "variety_name", *(["sales_year"] if per_year else []), "expected_sales", "stock_on_hand", "incoming",
        F.round(need, 4).alias("production_need"), F.round(ending, 4).alias("ending_stock"), status.alias("status"),
        F.col("red_threshold").cast("double").alias("red_threshold"))


def headline(plan: DataFrame) -> DataFrame:
    """Total to produce, red products, products that need production."""
    return plan.filter("status <> 'stopped'").agg(
        F.round(F.sum(F.col("production_need").cast(QTY)).cast("double"), 0).alias("total_to_produce"),
        F.count_if(F.col("status") == "red").alias("varieties_red"),
        F.count_if(F.col("production_need") > 0).alias("varieties_needing_production"),
        F.count(F.lit(1)).alias("rows_active"))


def action() -> Column:
    return F.when(F.col("production_need") > 0, F.lit("produce now")).otherwise(F.lit("watch"))


def at_risk(plan: DataFrame) -> DataFrame:
    """Red products, what they miss and what to do."""
    return plan.filter("status = 'red'").withColumns({
        "action": action(), "below_line": F.round(F.col("red_threshold") - F.col("ending_stock"), 4)})


def channel_mismatches(plan: DataFrame, forecast: DataFrame, tol: float = 0.05) -> DataFrame:
    """Plan rows whose expected sales differ from the re-summed channels; none are expected."""
    detail = forecast.withColumn("qty", F.col("qty").cast(QTY))
    base = plan.filter("sales_year is not null").select("product_key", "sales_year", "expected_sales")
    return reconcile_sums(base, detail, ["product_key", "sales_year"], "expected_sales", "qty", tol, "channel_sum").withColumn(
        "channel_sum", F.col("channel_sum").cast("double"))


def uplift_grid(lo: float = -0.2, hi: float = 0.5, step: float = 0.05) -> list[float]:
    n = round((hi - lo) / step)
    return [round(lo + i * step, 10) for i in range(n + 1)]


def what_if(plan: DataFrame, uplifts: Sequence[float], stock_shock: float = 0.0,
            capacity: float | None = None, floor: bool = False) -> DataFrame:
    """Total need under each sales uplift.

    One aggregation holds a sum per uplift and is unfolded afterwards; plan rows are never
    multiplied. As specified the need is not floored, so surplus nets against shortage; ``floor``
    changes that. ``capacity`` is the largest quantity that can be produced and yields the shortfall.
    """
    def need(u: float) -> Column:
        sales = F.col("expected_sales") * F.lit(1.0 + u)
        n = sales - F.col("stock_on_hand") * F.lit(1.0 + stock_shock) - F.col("incoming")
        return F.greatest(n, F.lit(0.0)) if floor else n

    sums = plan.agg(*[F.sum(need(u).cast(QTY)).cast("double").alias(f"_{i}") for i, u in enumerate(uplifts)])
    rows = F.array(*[F.struct(F.lit(float(u)).alias("uplift"), F.round(F.col(f"_{i}"), 2).alias("production_need")) for i, u in enumerate(uplifts)])
    out = sums.select(F.inline(rows))
    if capacity is not None:
        out = out.withColumn("shortfall", F.greatest(F.round(F.col("production_need") - F.lit(float(capacity)), 2), F.lit(0.0)))
    return out


def lot_size(plan: DataFrame, lot: int = 50, minimum: int = 150, exact_multiples: bool = False) -> DataFrame:
    """Planner batch per product in need, and its gap to the need.

    As specified a need that is an exact multiple still gets one more lot; ``exact_multiples`` keeps it.
    """
    lots = F.col("production_need") / F.lit(float(lot))
    count = F.ceil(lots) if exact_multiples else F.floor(lots) + 1
    target = F.greatest(count * F.lit(lot), F.lit(minimum)).cast("bigint")
    return plan.filter("production_need > 0").withColumn("plan_target", target).withColumn(
        "lot_gap", F.round(F.col("plan_target") - F.col("production_need"), 4))


def start_by(plan: DataFrame, due: Column | str, lead_months: int = 12) -> DataFrame:
    """Latest day production may start to be there on the due day."""
    day = F.col(due) if isinstance(due, str) else due
    return plan.withColumn("start_by", F.add_months(day, -lead_months))


def roll_forward(params: DataFrame, forecast: DataFrame, stock: DataFrame, incoming: DataFrame,
                 stock_order: Sequence[str] = ("as_of_date",)) -> DataFrame:
    """Yearly need when ending stock carries over and each need refills to the safety level.

    The recursion has a closed form: the cumulative need is the running maximum of
    ``safety - (opening + cumulative flow)``, never below zero, and a year's need is its increase. Windows
    hold one product's years, a handful of rows. Incoming counts in its arrival year.
    """
    sales = _sum_qty(forecast, ["product_key", "sales_year"], "sales")
    arriving = _sum_qty(incoming.withColumn("sales_year", F.year("arrival_date").cast("string")), ["product_key", "sales_year"], "incoming")
    flows = sales.join(arriving, ["product_key", "sales_year"], "full").select(
        "product_key", "sales_year", F.coalesce("sales", F.lit(0.0)).alias("sales"), F.coalesce("incoming", F.lit(0.0)).alias("incoming"))
    base = params.filter(active_or_unknown("active")).select("product_key", F.coalesce(F.greatest(F.col("safety_floor").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("safety"))
    d = flows.join(base, "product_key").join(latest_stock(stock, stock_order), "product_key", "left")
    years = Window.partitionBy("product_key").orderBy("sales_year")
    upto = years.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_level", F.coalesce("stock_on_hand", F.lit(0.0)) + F.sum(F.col("incoming") - F.col("sales")).over(upto))
    d = d.withColumn("_cum", F.greatest(F.max(F.col("safety") - F.col("_level")).over(upto), F.lit(0.0)))
    return d.select(
        "product_key", "sales_year", "sales", "incoming",
        F.round(F.col("_cum") - F.coalesce(F.lag("_cum").over(years), F.lit(0.0)), 4).alias("production_need"),
        F.round(F.col("_level") + F.col("_cum"), 4).alias("ending_stock"))


def history(snapshots: DataFrame) -> DataFrame:
    """How each product's plan moved from one snapshot to the next."""
    w = Window.partitionBy("product_key", "sales_year").orderBy("snapshot_date")
    return snapshots.select(
        "product_key", "sales_year", "snapshot_date", "expected_sales", "ending_stock", "production_need", "status",
        F.round(F.col("production_need") - F.lag("production_need").over(w), 4).alias("need_change"))


def plan_vs_actual(snapshots: DataFrame, actual: DataFrame) -> DataFrame:
    """The last committed plan of each product and year against what was sold."""
    last = latest_per_key(snapshots, ["product_key", "sales_year"], ["snapshot_date"], keep=["product_key", "sales_year", "expected_sales"])
    sold = _sum_qty(actual, ["product_key", "sales_year"], "actual_sales")
    joined = last.join(sold, ["product_key", "sales_year"], "left").withColumn("actual_sales", F.coalesce("actual_sales", F.lit(0.0)))
    return joined.withColumn("variance", F.round(F.col("actual_sales") - F.col("expected_sales"), 4))
