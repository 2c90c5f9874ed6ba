"""Streaming jobs. Every function turns a streaming DataFrame into another; runners write it.

The watermark delay is an argument everywhere (default one day); rows later than it are dropped. State is
one row per source, entity or open window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import StructType

from bizlens.functions.textual import content_hash
from bizlens.operators.ordering import latest_per_key
from bizlens.session import scratch_path
from bizlens.sources.sinks import upsert

DELAY = "1 day"


def file_stream(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream; the schema is always given."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def _by_wall_clock(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """Watermarked ``_wall`` column: windows over it start at local midnight, in any session time zone."""
    return df.withColumn("_wall", F.from_utc_timestamp(ts, F.current_timezone())).withWatermark("_wall", delay)


def _instant(wall: str) -> Column:
    return F.to_utc_timestamp(wall, F.current_timezone())


# -- transformations ----------------------------------------------------------------------------------
def source_health(runs: DataFrame) -> DataFrame:
    """Last run, last success and failures per source, kept up to date (complete mode)."""
    ok = F.col("status") == "ok"
    return runs.groupBy("source").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(~ok).alias("failures"), F.max("ts").alias("last_run"),
        F.max(F.when(ok, F.col("ts"))).alias("last_success"))


def with_silence(health: DataFrame, grace_hours: float) -> DataFrame:
    """Sources whose last success lies more than the grace period before the newest run of any source."""
    newest = health.agg(F.max("last_run")).scalar()
    quiet = F.timestamp_diff("SECOND", F.col("last_success"), newest) / 3600.0
    return health.withColumn("silent", F.coalesce(quiet > F.lit(grace_hours), F.lit(True)))


class SilenceTimer(StatefulProcessor):
    """Per source: the time of its last success, and an event-time timer at that time plus the grace period.

    A success that arrives more than the grace period after the one before closes a silence at once; otherwise the
    timer fires when the watermark passes the grace period without a new success. Each silence is reported once.
    """

    def __init__(self, grace_us: int) -> None:
        self.grace = grace_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long, alerted boolean")

    def _alert(self, source: str, us: int):
        import pandas as pd

        return pd.DataFrame({"source": [source], "last_us": [us], "alert_us": [us + self.grace]})

    def handleInputRows(self, key, rows, timerValues: TimerValues):
        import pandas as pd

        prev, alerted = self.last.get() if self.last.exists() else (None, False)
        times = sorted({int(t) for r in rows for t in r.loc[r["status"] == "ok", "us"] if prev is None or int(t) > prev})
        alerts = []
        for t in times:
            if prev is not None and t - prev > self.grace and not alerted:
                alerts.append((key[0], prev, prev + self.grace))
            prev, alerted = t, False
        if times:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.last.update((prev, False))
            self.handle.registerTimer((prev + self.grace) // 1000 + 1)
        yield pd.DataFrame(alerts, columns=["source", "last_us", "alert_us"])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo):
        last, _ = self.last.get()
        self.last.update((last, True))
        yield self._alert(key[0], last)

    def close(self) -> None:
        pass


def silence_alerts(runs: DataFrame, grace_hours: float, delay: str = DELAY) -> DataFrame:
    """``(source, last_success, alert_at)`` for each silence longer than the grace period after a success of a source.

    ``runs`` holds ``source``, ``ts`` and ``status`` (``ok`` counts as success). A silence ends with the next success,
    or is reported when the watermark (newest time less ``delay``) passes ``last_success`` plus the grace period.
    Rows older than their source's last success are ignored; a source without a success raises no alert.
    """
    spark = runs.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").find("RocksDB") < 0:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                       "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = runs.select("source", "ts", "status", F.unix_micros("ts").alias("us")).withWatermark("ts", delay)
    out = rows.groupBy("source").transformWithStateInPandas(SilenceTimer(int(grace_hours * 3_600_000_000)), "source string, last_us long, alert_us long",
                                                            "Append", "EventTime")
    return out.select("source", F.timestamp_micros("last_us").alias("last_success"), F.timestamp_micros("alert_us").alias("alert_at"))


def dedupe(df: DataFrame, cols: list[str], ts: str = "ts", delay: str = DELAY) -> DataFrame:
    """First row per content hash within the watermark; copies inside it are dropped."""
    return df.withColumn("content_hash", content_hash(*cols)).withWatermark(ts, delay).dropDuplicatesWithinWatermark(["content_hash"])


def signals_per_day(df: DataFrame, by: str = "rule", ts: str = "ts", delay: str = DELAY) -> DataFrame:
    counts = _by_wall_clock(df, ts, delay).groupBy(F.window("_wall", "1 day"), by).agg(F.count(F.lit(1)).alias("signals"))
    return counts.select(F.to_date(_instant("window.start")).alias("day"), by, "signals")


def convergence(mentions: DataFrame, window: str = "7 days", slide: str = "1 day", sources: int = 3, delay: str = DELAY) -> DataFrame:
    """Entities with enough sources in a sliding window.

    Streaming aggregation has no exact distinct count; the sketch is close to exact for the handful of sources per
    entity and window that the rule looks at. The batch function is the exact twin for any number.
    """
    seen = _by_wall_clock(mentions, "ts", delay).groupBy(F.window("_wall", window, slide), "entity").agg(
        F.approx_count_distinct("source").alias("n_sources"), F.approx_count_distinct("bucket").alias("n_buckets"))
    rule = F.when(F.col("n_buckets") >= 2, "convergence").otherwise("weak_signal")
    return seen.filter(F.col("n_sources") >= sources).select(
        _instant("window.start").alias("window_start"), _instant("window.end").alias("window_end"), "entity", "n_sources", "n_buckets", rule.alias("rule"))


def mention_counts(mentions: DataFrame, every: str = "1 day", delay: str = DELAY) -> DataFrame:
    """Mentions per entity and closed window (append mode)."""
    counts = _by_wall_clock(mentions, "ts", delay).groupBy(F.window("_wall", every), "entity").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(_instant("window.start").alias("window_start"), "entity", "n")


# -- runners ------------------------------------------------------------------------------------------
# ``state`` is the checkpoint folder of a job. Give the same one on every start, and a job goes on where it stopped; without
# one a run is on its own and reads its whole input.
def _run(df: DataFrame, writer, label: str, state: str | None) -> StreamingQuery:
    q = writer.option("checkpointLocation", state or scratch_path(df.sparkSession, f"{label}-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def run_append(df: DataFrame, path: str, label: str = "append", state: str | None = None) -> StreamingQuery:
    """Process what is there into Parquet files, each row once (also over restarts with one ``state``)."""
    return _run(df, df.writeStream.outputMode("append").format("parquet").option("path", path), label, state)


def run_each_batch(df: DataFrame, sink: Callable[[DataFrame, int], None], mode: str = "append", label: str = "batches", state: str | None = None) -> StreamingQuery:
    """Hand every micro-batch to ``sink``."""
    return _run(df, df.writeStream.outputMode(mode).foreachBatch(sink), label, state)


def run_complete(df: DataFrame, path: str, label: str = "complete", state: str | None = None) -> StreamingQuery:
    """Replace the result table after every micro-batch. All groups stay in the state, so use it for few groups (sources, rules by day)."""
    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)
    return run_each_batch(df, replace, "complete", label, state)


def plan_sink(spark: SparkSession, store: str, keys: list[str], recompute: Callable[[DataFrame], DataFrame], out: str,
              run: str = "plan") -> Callable[[DataFrame, int], None]:
    """Upsert the landed inputs into the versioned store and rewrite the plan from its newest version. ``run`` names the job (its state
    folder, say): a batch that the log of the store has for this name is applied again to the same version, not twice."""
    def land(batch: DataFrame, batch_id: int) -> None:
        latest = upsert_version(spark, store, batch, keys, batch_id, run)
        recompute(latest).write.mode("overwrite").parquet(out)
    return land


LOG = "version long, run string, batch_id long"


def _folder(spark: SparkSession, path: str):
    """A path and its file system, wherever it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def upsert_version(spark: SparkSession, store: str, batch: DataFrame, keys: list[str], batch_id: int, run: str = "plan") -> DataFrame:
    """The store with the batch put in place by key, written as a new version and returned.

    The store's log has a row per applied batch. A batch not in it goes on top of the newest version, also from a job that starts
    anew at batch 0; a batch already in it is written again on top of the version before it. Of each batch's repeated keys one row
    is taken by a hash of the row. The newest three versions are kept.
    """
    fs, log = _folder(spark, f"{store}/log")
    applied = [tuple(r) for r in spark.read.schema(LOG).parquet(f"{store}/log").collect()] if fs.exists(log) else []
    known = [v for v, r, b in applied if r == run and b == batch_id]
    newest = max([v for v, _, _ in applied], default=-1)
    version = known[0] if known else newest + 1
    if known and version < newest:
        return spark.read.parquet(f"{store}/v{newest}")  # later batches are on top of it already
    fresh = latest_per_key(batch, keys, [])
    if version > 0:
        fresh = upsert(spark.read.parquet(f"{store}/v{version - 1}"), fresh, keys)
    fresh.select(*batch.columns).write.mode("overwrite").parquet(f"{store}/v{version}")
    if not known:
        row = F.struct(F.lit(version).cast("long").alias("version"), F.lit(run).alias("run"), F.lit(batch_id).cast("long").alias("batch_id"))
        spark.range(1).select(F.inline(F.array(row))).write.mode("append").parquet(f"{store}/log")
        fs, old = _folder(spark, f"{store}/v{version - 3}")
        if version >= 3 and fs.exists(old):
            fs.delete(old, True)
    return spark.read.parquet(f"{store}/v{version}")


def zero_signal_sink(alerts: str) -> Callable[[DataFrame, int], None]:
    """Write one alert row per micro-batch that brought no signal, which points to a broken run."""
    def check(batch: DataFrame, batch_id: int) -> None:
        n = batch.count()
        if n == 0:
            batch.sparkSession.range(1).select(F.lit(batch_id).alias("batch_id"), F.lit("no signals").alias("alert")).write.mode("append").parquet(alerts)
    return check


def zero_signal_days(counts: DataFrame, start: str, end: str) -> DataFrame:
    """Days of the range without any signal (batch twin over the written counts)."""
    days = counts.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"))
    return days.join(counts.select("day").distinct(), "day", "left_anti")
