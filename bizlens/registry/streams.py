"""Streaming jobs run over the event table to completion, checked against batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizlens.plans import planning, signals
from bizlens.registry.base_sql import sql
from bizlens.registry.common import q
from bizlens.registry.markets import CONV, RUNS
from bizlens.session import scratch_path
from bizlens.sources.warehouse import Warehouse
from bizlens.streaming import jobs


class StreamedWarehouse(Warehouse):
    """The same logical tables with the event feed read as a stream."""

    def table(self, name: str) -> DataFrame:
        if name != "events":
            return super().table(name)
        schema = super().table("events").schema
        return jobs.file_stream(self.spark, self.folder, schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _streamed(w: Warehouse) -> StreamedWarehouse:
    return StreamedWarehouse(w.spark, w.folder)


def _complete(w: Warehouse, df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(w.spark, label)
    jobs.run_complete(df, path, label)
    return w.spark.read.parquet(path)


def _appended(w: Warehouse, df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(w.spark, label)
    jobs.run_append(df, path, label)
    return w.spark.read.parquet(path)


def _health(w: Warehouse) -> DataFrame:
    runs = _streamed(w).table("events").select(F.col("event_type").alias("source"), "ts", F.when(F.col("value") < 1, "failed").otherwise("ok").alias("status"))
    return jobs.with_silence(_complete(w, jobs.source_health(runs), "health"), 1).select("source", "runs", "failures", "silent")


def _silences(w: Warehouse) -> DataFrame:
    runs = _streamed(w).table("events").select(F.col("event_type").alias("source"), "ts", F.when(F.col("value") < 1, "failed").otherwise("ok").alias("status"))
    out = _appended(w, jobs.silence_alerts(runs, 1), "silences")
    return out.select("source", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) for c in ("last_success", "alert_at")])


def _per_day(w: Warehouse) -> DataFrame:
    m = _streamed(w).mentions().select("ts", F.col("bucket").alias("rule"))
    return _complete(w, jobs.signals_per_day(m), "per-day")


def _counts(w: Warehouse) -> DataFrame:
    return _appended(w, jobs.mention_counts(_streamed(w).mentions()), "counts").select(F.to_date("window_start").alias("day"), "entity", "n")


def _spikes(w: Warehouse) -> DataFrame:
    """Closed daily counts from the stream, then the trailing baseline on the written table; silent until the history exists."""
    closed = _counts(w)
    out = signals.baseline_z(closed, ["entity"], "day", "n", 14)
    return out.filter((F.col("z") > 2) & (F.col("history_days") >= 14)).select("entity", "day", "n", F.round("z", 6).alias("z"))


def _unique(w: Warehouse) -> DataFrame:
    e = _streamed(w).table("events").select("event_id", "ts", "user_id", F.to_date("ts").alias("day"), "event_type")
    return _appended(w, jobs.dedupe(e, ["user_id", "event_type", "day"], delay="1 day"), "unique").select("user_id", "event_type", "day")


def _convergence(w: Warehouse) -> DataFrame:
    path = _complete(w, jobs.convergence(_streamed(w).mentions()), "convergence")
    return path.select("entity", F.date_sub(F.to_date("window_end"), 1).alias("window_end"), "n_sources", "n_buckets", "rule")


def _plan(w: Warehouse) -> DataFrame:
    """Stock counts arrive as a stream; the plan is rewritten from the latest counts."""
    from bizlens.registry.money import YEAR

    schema = w.table("lineitem").schema
    lines = jobs.file_stream(w.spark, w.folder, schema, "lineitem.parquet").filter("l_linestatus = 'F'")
    counts = lines.groupBy(F.col("l_partkey").alias("product_key")).agg(
        F.max_by(F.col("l_quantity").cast("decimal(18,2)"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice")).alias("qty"),
        F.max(F.to_date("l_shipdate")).alias("as_of_date"))
    store, out = scratch_path(w.spark, "stock"), scratch_path(w.spark, "plan")

    def recompute(stock: DataFrame) -> DataFrame:
        return planning.production_plan(w.params(), w.forecast(), stock, w.incoming(), year=YEAR)

    jobs.run_each_batch(counts, jobs.plan_sink(w.spark, store, ["product_key"], recompute, out), "update", "plan")
    return w.spark.read.parquet(out).select("product_key", "stock_on_hand", "production_need", "ending_stock", "status")


def _quiet_days(w: Warehouse) -> DataFrame:
    return jobs.zero_signal_days(_per_day(w).filter("rule = 'risk'"), "2023-12-25", "2024-02-05")


def _plan_twin() -> str:
    from bizlens.registry.money import plan_sql

    return plan_sql("SELECT product_key, stock_on_hand, production_need, ending_stock, status FROM plan")


CLOSED = "(SELECT date_trunc('day', max(ts) - INTERVAL 1 DAY) FROM mentions)"

QUERIES = {
    "stream_source_health": (q(_health), RUNS + """
        SELECT source, count(*) AS runs, count(*) FILTER (WHERE status <> 'ok') AS failures,
               date_sub('second', max(ts) FILTER (WHERE status = 'ok'), (SELECT max(ts) FROM runs)) / 3600.0 > 1 AS silent FROM runs GROUP BY source"""),
    "stream_silence_alerts": (q(_silences), RUNS + """
        , ok AS (SELECT source, ts, lead(ts) OVER (PARTITION BY source ORDER BY ts) AS next FROM (SELECT DISTINCT source, ts FROM runs WHERE status = 'ok'))
        SELECT source, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS last_success, strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS alert_at FROM ok
        WHERE CASE WHEN next IS NULL THEN (SELECT max(ts) FROM runs) - INTERVAL 1 DAY > ts + INTERVAL 1 HOUR ELSE next - ts > INTERVAL 1 HOUR END"""),
    "stream_signals_per_day": (q(_per_day), sql("mentions", "SELECT day, bucket AS rule, count(*) AS signals FROM mentions GROUP BY ALL")),
    "stream_mention_counts": (q(_counts), sql("mentions", f"SELECT day, entity, count(*) AS n FROM mentions WHERE ts < {CLOSED} GROUP BY ALL")),
    "stream_spikes": (q(_spikes), sql("mentions", f"""
        , daily AS (SELECT entity, day, count(*) AS n FROM mentions WHERE ts < {CLOSED} GROUP BY ALL),
        b AS (SELECT *, date_diff('day', min(day) OVER (PARTITION BY entity), day) AS history, CAST(coalesce(sum(n) OVER w, 0) AS DOUBLE) AS s, CAST(coalesce(sum(n * n) OVER w, 0) AS DOUBLE) AS q FROM daily
              WINDOW w AS (PARTITION BY entity ORDER BY day RANGE BETWEEN INTERVAL 14 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)),
        c AS (SELECT *, (n - s / 14) / nullif(sqrt(greatest((q - s * s / 14) / 13, 0)), 0) AS z FROM b)
        SELECT entity, day, n, round(z, 6) AS z FROM c WHERE z > 2 AND history >= 14""".strip())),
    "stream_unique_ingest": (q(_unique), "SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events"),
    "stream_convergence": (q(_convergence), sql("mentions", CONV + " SELECT entity, window_end, n_sources, n_buckets, rule FROM conv")),
    "stream_plan": (q(_plan), _plan_twin()),
    "stream_quiet_days": (q(_quiet_days), sql("mentions", """
        SELECT CAST(DATE '2023-12-25' + CAST(i AS INTEGER) AS DATE) AS day FROM range(43) x(i) WHERE DATE '2023-12-25' + CAST(i AS INTEGER) NOT IN (SELECT day FROM mentions WHERE bucket = 'risk')""")),
}
