import datetime as dt

import pytest
from pyspark.sql import functions as F

from bizlens.plans import signals
from bizlens.sources.calendar import dim_date
from bizlens.streaming import jobs
from tests.conftest import rows

T0 = dt.datetime(2024, 1, 10)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


@pytest.fixture
def feed(spark, make, tmp_path):
    """Write batches as files and read them as a stream, one file per micro-batch."""
    def build(batches, ddl):
        folder = str(tmp_path / "in")
        for i, batch in enumerate(batches):
            df = make(batch, ddl)
            df.coalesce(1).write.mode("append").parquet(folder)
            schema = df.schema
        return jobs.file_stream(spark, folder, schema, files_per_batch=1)
    return build


def test_copies_within_and_beyond_the_watermark(spark, feed, tmp_path):
    stream = feed([[(1, "a", at(0)), (2, "a", at(1)), (3, "b", at(1))], [(4, "a", at(2))], [(5, "c", at(60))], [(6, "d", at(61))], [(7, "a", at(62))]], "id int, t string, ts timestamp")
    out = str(tmp_path / "out")
    jobs.run_append(jobs.dedupe(stream, ["t"]), out)
    got = [r["t"] for r in spark.read.parquet(out).collect()]
    assert sorted(got) == ["a", "a", "b", "c", "d"]


def test_late_rows_are_dropped_and_closed_windows_written(spark, feed, tmp_path):
    stream = feed([[("e", at(1)), ("e", at(2))], [("e", at(80))], [("e", at(81))], [("e", at(3))], [("e", at(140))]], "entity string, ts timestamp")
    out = str(tmp_path / "out")
    jobs.run_append(jobs.mention_counts(stream), out)
    assert rows(spark.read.parquet(out), F.to_date("window_start"), "n") == [(dt.date(2024, 1, 10), 2), (dt.date(2024, 1, 13), 2)]


def test_stream_convergence_equals_batch(spark, feed, make, tmp_path):
    data = [("e", s, b, at(24 * d)) for s, b, d in (("a", "x", 0), ("b", "y", 2), ("c", "x", 6))] + [("f", "a", "x", at(0)), ("f", "b", "x", at(1)), ("f", "c", "x", at(2))]
    ddl = "entity string, source string, bucket string, ts timestamp"
    out = str(tmp_path / "out")
    jobs.run_complete(jobs.convergence(feed([data[:3], data[3:]], ddl)), out)
    streamed = spark.read.parquet(out).select("entity", F.date_sub(F.to_date("window_end"), 1).alias("window_end"), "rule")
    batch = signals.convergence(make(data, ddl).withColumn("day", F.to_date("ts"))).select("entity", "window_end", "rule")
    assert rows(streamed) == rows(batch)


def test_per_day_and_quiet_days(spark, feed, tmp_path):
    out = str(tmp_path / "out")
    jobs.run_complete(jobs.signals_per_day(feed([[("r", at(0)), ("r", at(1))], [("r", at(50))]], "rule string, ts timestamp")), out)
    counts = spark.read.parquet(out)
    assert rows(counts) == [(dt.date(2024, 1, 10), "r", 2), (dt.date(2024, 1, 12), "r", 1)]
    assert rows(jobs.zero_signal_days(counts, "2024-01-10", "2024-01-13")) == [(dt.date(2024, 1, 11),), (dt.date(2024, 1, 13),)]
    assert dim_date(spark, "2024-01-10", "2024-01-13").count() == 4


def test_silent_source(spark, feed, tmp_path):
    out = str(tmp_path / "out")
    runs = feed([[("a", at(0), "ok"), ("b", at(0), "ok"), ("c", at(1), "failed")], [("a", at(30), "ok")]], "source string, ts timestamp, status string")
    jobs.run_complete(jobs.source_health(runs), out)
    assert rows(jobs.with_silence(spark.read.parquet(out), 24), "source", "silent") == [("a", False), ("b", True), ("c", True)]


def test_landing_inputs_rewrites_the_plan(spark, feed, tmp_path):
    store, out = str(tmp_path / "store"), str(tmp_path / "plan")
    stream = feed([[("p", 5), ("q", 7)], [("p", 9)]], "k string, v int")
    jobs.run_each_batch(stream, jobs.plan_sink(spark, store, ["k"], lambda d: d.withColumn("double", F.col("v") * 2), out))
    assert rows(spark.read.parquet(out)) == [("p", 9, 18), ("q", 7, 14)]
    again = jobs.upsert_version(spark, store, spark.createDataFrame([("p", 9)], "k string, v int"), ["k"], 1)
    assert rows(again) == [("p", 9), ("q", 7)]


def test_an_empty_run_raises_an_alert(spark, feed, tmp_path):
    alerts = str(tmp_path / "alerts")
    stream = feed([[("keep",)], [("drop",)]], "t string").filter("t = 'keep'")
    jobs.run_each_batch(stream, jobs.zero_signal_sink(alerts))
    assert rows(spark.read.parquet(alerts)) == [(1, "no signals")]


def test_a_stopped_job_goes_on_with_new_files(spark, make, tmp_path):
    folder, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    ddl = "id int, t string, ts timestamp"
    for k in range(3):
        make([(k, f"t{k}", at(k)), (k + 10, "same", at(k))], ddl).coalesce(1).write.mode("append").parquet(folder)
        stream = jobs.file_stream(spark, folder, make([], ddl).schema, files_per_batch=1)
        jobs.run_append(jobs.dedupe(stream, ["t"]), out, state=state)
    assert sorted(r["t"] for r in spark.read.parquet(out).collect()) == ["same", "t0", "t1", "t2"]


@pytest.mark.parametrize("kept_state", [True, False])
def test_the_store_outlives_a_restart(spark, make, tmp_path, kept_state):
    folder, store, out = str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "plan")
    ddl = "k string, v int"
    for n, rows_in in enumerate([[("p", 5), ("q", 7)], [("p", 9)], [("r", 1)], [("q", 8)]]):
        make(rows_in, ddl).coalesce(1).write.mode("append").parquet(folder)
        state = str(tmp_path / "state") if kept_state else str(tmp_path / f"state{n}")
        sink = jobs.plan_sink(spark, store, ["k"], lambda d: d, out, run=state)
        jobs.run_each_batch(jobs.file_stream(spark, folder, make([], ddl).schema, files_per_batch=1), sink, state=state)
        if n == 1:
            again = jobs.upsert_version(spark, store, make(rows_in, ddl), ["k"], 1, state)
            assert rows(again) == [("p", 9), ("q", 7)]
    assert rows(spark.read.parquet(out)) == [("p", 9), ("q", 8), ("r", 1)]
    assert sum(p.name.startswith("v") for p in (tmp_path / "store").iterdir()) <= 3


def _silences_by_batch(data, grace, delay_hours):
    """Each success followed by a gap over the grace period, or by none before the final watermark."""
    newest = max(ts for _, ts, _ in data)
    out = []
    for source in {s for s, _, _ in data}:
        ok = sorted({ts for s, ts, st in data if s == source and st == "ok"})
        for a, b in zip(ok, ok[1:] + [None]):
            end = b if b is not None else newest - dt.timedelta(hours=delay_hours)
            if end - a > dt.timedelta(hours=grace):
                out.append((source, a, a + dt.timedelta(hours=grace)))
    return sorted(out)


def test_silence_alerts_by_timer_equal_batch_also_over_a_restart(spark, make, tmp_path):
    data = [("a", at(0), "ok"), ("b", at(0), "ok"), ("a", at(0.5), "ok"), ("c", at(1), "failed"), ("a", at(3), "ok"),
            ("b", at(2), "failed"), ("a", at(4), "failed"), ("b", at(30), "ok"), ("a", at(30.5), "ok"), ("b", at(31), "ok"), ("a", at(60), "ok")]
    ddl = "source string, ts timestamp, status string"
    folder, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    for part in (data[:5], data[5:8]):
        make(part, ddl).coalesce(1).write.mode("append").parquet(folder)
    schema = make(data, ddl).schema
    jobs.run_append(jobs.silence_alerts(jobs.file_stream(spark, folder, schema, files_per_batch=1), 1), out, state=state)
    make(data[8:], ddl).coalesce(1).write.mode("append").parquet(folder)
    for _ in range(2):  # restarted from its state: nothing is read or reported twice
        jobs.run_append(jobs.silence_alerts(jobs.file_stream(spark, folder, schema, files_per_batch=1), 1), out, state=state)
    got = rows(spark.read.parquet(out), "source", "last_success", "alert_at")
    assert got == _silences_by_batch(data, 1, 24)
    assert ("a", at(3), at(4)) in got and ("b", at(0), at(1)) in got and ("b", at(31), at(32)) in got
