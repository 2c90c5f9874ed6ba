"""Signals: contribution of flags, the rule detector, ranking, evidence, health and feeds."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bizlens.functions.bands import additive, any_signal
from bizlens.functions.metrics import ratio
from bizlens.operators.ordering import baseline_z, diversify, last_n

# The default points per signal.
SIGNAL_POINTS = {
    "has_jobposting": 10, "has_paid_ads": 8, "has_review_presence": 5,
    "has_news_mention": 5, "recently_registered": 8, "expansion_signal": 6,
}


# -- flags ------------------------------------------------------------------------------------------
def intent_score(df: DataFrame, points: Mapping[str, int] = SIGNAL_POINTS, base: Column | None = None) -> DataFrame:
    score = additive(points)
    return df.withColumn("intent_score", score if base is None else score + base)


def contribution(df: DataFrame, points: Mapping[str, int] = SIGNAL_POINTS) -> DataFrame:
    """Reach and total points per signal: one aggregation, then unfolded."""
    present = {s: p for s, p in points.items() if s in df.columns}
    sums = df.agg(*[F.sum(s).cast("bigint").alias(s) for s in present])
    rows = F.array(*[
        F.struct(F.lit(s).alias("signal"), F.col(s).alias("records_with_signal"), F.lit(p).alias("pts_per_record"),
                 (F.col(s) * p).alias("total_pts_contribution")) for s, p in present.items()])
    return sums.select(F.inline(rows))


def ablation(df: DataFrame, points: Mapping[str, int] = SIGNAL_POINTS, score: str = "intent_score") -> DataFrame:
    """Average score lost when one signal is taken out."""
    present = {s: p for s, p in points.items() if s in df.columns}
    base = F.avg(score)
    sums = df.agg(*[F.round(base - F.avg(F.col(score) - F.col(s) * p), 6).alias(s) for s, p in present.items()])
    rows = F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).alias("score_loss_if_removed")) for s in present])
    return sums.select(F.inline(rows))


def coverage(df: DataFrame, flags: Sequence[str], core: Sequence[str]) -> DataFrame:
    """Records with at least one, two and three signals, and the share that carries a core signal."""
    n = reduce(lambda a, b: a + b, [F.col(f) for f in flags])
    g = df.select(n.alias("_n"), any_signal(list(core)).alias("_c")).agg(
        F.count(F.lit(1)).alias("records"), *[F.count_if(F.col("_n") >= k).alias(f"at_least_{k}") for k in (1, 2, 3)],
        F.avg("_n").alias("avg_signals"), F.count_if("_c").alias("covered"))
    return g.withColumns({"avg_signals": F.round("avg_signals", 6), "coverage": F.round(ratio("covered", "records"), 6)})


def lift(df: DataFrame, flags: Sequence[str], score: str = "intent_score") -> DataFrame:
    """Mean score with and without each signal, from one aggregation."""
    aggs = []
    for f in flags:
        aggs += [F.avg(F.when(F.col(f) == 1, F.col(score))).alias(f"{f}__1"), F.avg(F.when(F.col(f) == 0, F.col(score))).alias(f"{f}__0")]
    g = df.agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(f).alias("signal"), F.round(F.col(f"{f}__1"), 6).alias("avg_present"), F.round(F.col(f"{f}__0"), 6).alias("avg_absent"),
                 F.round(F.col(f"{f}__1") - F.col(f"{f}__0"), 6).alias("lift")) for f in flags])
    return g.select(F.inline(rows))


def score_by_total(df: DataFrame, flags: Sequence[str], score: str = "intent_score") -> DataFrame:
    n = reduce(lambda a, b: a + b, [F.col(f) for f in flags])
    return df.groupBy(n.alias("n_signals")).agg(F.count(F.lit(1)).alias("records"), F.round(F.avg(score), 6).alias("avg_score"))


# -- rules ------------------------------------------------------------------------------------------
def convergence(mentions: DataFrame, days: int = 7, sources: int = 3, buckets: int = 2) -> DataFrame:
    """Entities seen by enough sources inside a sliding window of whole days.

    Several buckets make a convergence, a single one a weak signal. Mentions are reduced to distinct
    (entity, source, bucket, day) rows before they enter the overlapping windows.
    """
    seen = mentions.select("entity", "source", "bucket", "day").distinct()
    ends = seen.select("entity", "source", "bucket", F.explode(F.sequence(F.col("day"), F.date_add("day", days - 1), F.expr("interval 1 day"))).alias("window_end"))
    facts = ends.distinct().groupBy("entity", "window_end").agg(
        F.count_distinct("source").alias("n_sources"), F.count_distinct("bucket").alias("n_buckets"))
    rule = F.when(F.col("n_buckets") >= buckets, "convergence").otherwise("weak_signal")
    return facts.filter(F.col("n_sources") >= sources).withColumn("rule", rule)


def daily_counts(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("entity", "day").agg(F.count(F.lit(1)).alias("n"))


def anomaly(mentions: DataFrame, days: int = 30, sigma: float = 2.0, week: int = 7) -> DataFrame:
    """Days on which an entity's last ``week`` days lie above its baseline by more than ``sigma``.

    The baseline is the ``days`` before that week, as a mean and deviation of daily counts scaled to a week;
    entities with less history than week and baseline together are silent.
    """
    num = F.datediff("day", F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy("entity").orderBy("_dn")
    base, recent = w.rangeBetween(-(days + week - 1), -week), w.rangeBetween(-(week - 1), 0)
    n = F.col("n").cast("double")
    d = daily_counts(mentions).withColumn("_dn", num).withColumns({
        "week_count": F.sum("n").over(recent), "_s": F.coalesce(F.sum(n).over(base), F.lit(0.0)),
        "_q": F.coalesce(F.sum(n * n).over(base), F.lit(0.0)),
        "history_days": (F.col("_dn") - F.min("_dn").over(Window.partitionBy("entity"))).cast("int")})
    mean = F.col("_s") / float(days)
    var = F.greatest((F.col("_q") - F.col("_s") * F.col("_s") / float(days)) / float(days - 1), F.lit(0.0))
    d = d.withColumns({"expected": mean * float(week), "_sd": F.sqrt(var * float(week))})
    d = d.withColumn("z", F.round(F.try_divide(F.col("week_count") - F.col("expected"), F.col("_sd")), 6))
    return d.filter((F.col("history_days") >= days + week - 1) & (F.col("z") > sigma)).select("entity", "day", "week_count", F.round("expected", 6).alias("expected"), "z")


def first_mover(mentions: DataFrame, days: int = 14) -> DataFrame:
    """Entities that a niche source carried at least ``days`` before the mainstream."""
    g = mentions.groupBy("entity").agg(
        F.min(F.when(F.col("tier") == "niche", F.col("day"))).alias("first_niche"),
        F.min(F.when(F.col("tier") == "mainstream", F.col("day"))).alias("first_mainstream"))
    lead = F.datediff("first_mainstream", "first_niche")
    return g.withColumn("lead_days", lead).filter(F.col("lead_days") >= days)


def geo_spread(mentions: DataFrame, route: Sequence[str] = ("CN", "EU", "US")) -> DataFrame:
    """Entities whose first mention moves along the route, later in each next region."""
    g = mentions.groupBy("entity").agg(*[F.min(F.when(F.col("region") == r, F.col("ts"))).alias(f"first_{r.lower()}") for r in route])
    names = [f"first_{r.lower()}" for r in route]
    ordered = reduce(lambda a, b: a & b, [F.col(a) < F.col(b) for a, b in zip(names, names[1:])])
    return g.filter(ordered)


def trend_break(prices: DataFrame, keys: Sequence[str], day: str, price: str, days: int = 30, sigma: float = 2.0) -> DataFrame:
    """Days whose price leaves the band of the rows of the ``days`` before it.

    ``prices`` has one row per key and day; days without a price do not count.
    """
    w = Window.partitionBy(*keys).orderBy(F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))).rangeBetween(-days, -1)
    d = prices.withColumns({"base_mean": F.avg(price).over(w), "base_std": F.stddev_samp(price).over(w), "base_n": F.count(price).over(w)})
    z = F.try_divide(F.col(price) - F.col("base_mean"), F.col("base_std"))
    return d.withColumn("z", z).filter(F.abs("z") > sigma)


def daily_z(mentions: DataFrame, days: int = 14) -> DataFrame:
    """Daily mention counts with their trailing baseline."""
    return baseline_z(daily_counts(mentions), ["entity"], "day", "n", days)


def run(mentions: DataFrame, history_days: int = 30, regions: Sequence[str] = ("CN", "EU", "US")) -> tuple[DataFrame, DataFrame]:
    """All rules, and the log of those that stayed silent for lack of data.

    Signals come as ``(rule, entity, day)``; the log as ``(rule, reason)``.
    """
    facts = mentions.agg(
        (F.datediff(F.max("day"), F.min("day"))).alias("span"), F.count_distinct("tier").alias("tiers"),
        F.count_distinct(F.when(F.col("region").isin(list(regions)), F.col("region"))).alias("regions"))
    found = convergence(mentions).groupBy("rule", "entity").agg(F.min("window_end").alias("day"))
    parts = [
        found.select("rule", "entity", "day"),
        anomaly(mentions, history_days).groupBy("entity").agg(F.min("day").alias("day")).select(F.lit("anomaly").alias("rule"), "entity", "day"),
        first_mover(mentions).select(F.lit("first_mover").alias("rule"), "entity", F.col("first_mainstream").alias("day")),
        geo_spread(mentions, regions).select(F.lit("geo_spread").alias("rule"), "entity", F.to_date(f"first_{regions[-1].lower()}").alias("day")),
    ]
    checks = F.array(
        F.struct(F.lit("anomaly").alias("rule"), F.lit("not enough history").alias("reason"), (F.col("span") < history_days + 6).alias("_off")),
        F.struct(F.lit("first_mover").alias("rule"), F.lit("sources carry no tiers").alias("reason"), (F.col("tiers") < 2).alias("_off")),
        F.struct(F.lit("geo_spread").alias("rule"), F.lit("regions missing").alias("reason"), (F.col("regions") < len(regions)).alias("_off")))
    log = facts.select(F.inline(checks)).filter("_off").select("rule", "reason")
    return reduce(DataFrame.unionByName, parts), log


# -- ranking, evidence, state -------------------------------------------------------------------------
def rank(signals: DataFrame, watchlist: DataFrame, k: int = 5) -> DataFrame:
    """The top ``k`` signals per customer by watchlist weight times strength."""
    scored = signals.join(watchlist, "entity").withColumn("rank_score", F.col("weight") * F.col("strength"))
    w = Window.partitionBy("customer").orderBy(F.col("rank_score").desc(), F.col("signal_id"))
    return scored.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)


def with_evidence(signals: DataFrame, evidence: DataFrame, entities: DataFrame) -> DataFrame:
    """One row per signal with its evidence and entity counts and its earliest quote.

    Each side is aggregated before its join, so neither multiplies the other. The
    complete lists are in :func:`evidence_rows`, as rows: a signal may have any number of them.
    """
    quotes = evidence.groupBy("signal_id").agg(F.count(F.lit(1)).alias("n_evidence"), F.min_by("quote", F.struct("ts", "evidence_id")).alias("first_quote"))
    names = entities.groupBy("signal_id").agg(F.count_distinct("entity").alias("n_entities"), F.min("entity").alias("first_entity"))
    out = signals.join(quotes, "signal_id", "left").join(names, "signal_id", "left")
    return out.withColumns({"n_evidence": F.coalesce("n_evidence", F.lit(0)), "n_entities": F.coalesce("n_entities", F.lit(0))})


def evidence_rows(signals: DataFrame, evidence: DataFrame, entities: DataFrame) -> DataFrame:
    """Every quote and every entity of the signals as ``(signal_id, kind, value)`` rows."""
    quotes = evidence.select("signal_id", F.lit("evidence").alias("kind"), F.col("quote").alias("value"))
    names = entities.select("signal_id", F.lit("entity").alias("kind"), F.col("entity").cast("string").alias("value")).distinct()
    return quotes.unionByName(names).join(signals.select("signal_id"), "signal_id", "left_semi")


def with_state(signals: DataFrame, state: DataFrame) -> DataFrame:
    """Per-customer triage state over shared signals; unseen signals are open."""
    return signals.join(state, ["customer", "signal_id"], "left").withColumn("state", F.coalesce("state", F.lit("open")))


def entity_timeline(mentions: DataFrame, entities: Sequence, until: dt.date, days: int = 30) -> DataFrame:
    """Mentions per day of the asked entities, days without mentions included."""
    start = until - dt.timedelta(days=days - 1)
    hits = mentions.filter(F.col("entity").isin(list(entities)) & F.col("day").between(start, until))
    counts = hits.groupBy("entity", "day").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("n_sources"))
    spine = mentions.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(e) for e in entities])).alias("entity"),
    ).withColumn("day", F.explode(F.sequence(F.lit(start), F.lit(until))))
    return spine.join(counts, ["entity", "day"], "left").withColumns({"n": F.coalesce("n", F.lit(0)), "n_sources": F.coalesce("n_sources", F.lit(0))})


def digest(ranked: DataFrame, week_start: dt.date) -> DataFrame:
    """The ranked signals of one week."""
    return ranked.filter(F.col("day").between(week_start, week_start + dt.timedelta(days=6)))


# -- sources ------------------------------------------------------------------------------------------
def source_health(runs: DataFrame, as_of: Column, grace_hours: int = 24) -> DataFrame:
    """Last run, last success and silence per source; all combined on the map side."""
    g = runs.groupBy("source").agg(
        F.count(F.lit(1)).alias("runs"), F.max("ts").alias("last_run"), F.max(F.when(F.col("status") == "ok", F.col("ts"))).alias("last_success"),
        F.max_by("status", F.struct("ts", "run_id")).alias("last_status"), F.count_if(F.col("status") != "ok").alias("failures"))
    quiet = F.timestamp_diff("SECOND", F.col("last_success"), as_of) / 3600.0
    return g.withColumn("silent", F.coalesce(quiet > grace_hours, F.lit(True)))


def run_history(runs: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` runs per source, newest first."""
    return last_n(runs, ["source"], [F.col("ts").desc(), F.col("run_id").desc()], n)


def feed(items: DataFrame, source: str = "source", size: int = 20, cap: int = 3) -> DataFrame:
    """First page of the newest items, at most ``cap`` per source."""
    return diversify(items, source, [F.col("ts").desc(), F.col("mention_id").desc()], size, cap)


def new_per_day(signals: DataFrame) -> DataFrame:
    return signals.groupBy("day", "rule").agg(F.count(F.lit(1)).alias("signals"))
