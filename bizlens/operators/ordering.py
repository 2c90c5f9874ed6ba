"""Shares, ranks, running totals, top-k and history windows.

Scale rules kept here:
* a global order is dealt by ranges of all its columns, whatever the size; no window runs over a whole frame;
* a key that holds a large part of the rows is split by time before its window runs;
* top-k per key keeps ``row_number() <= k`` right above the window, which Spark limits before the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType
from pyspark.sql.window import Window

from bizlens.functions.metrics import rate
from bizlens.session import materialise


def share(df: DataFrame, value: str, out: str, by: Sequence[str] = (), digits: int | None = 1) -> DataFrame:
    """Percent of the total of ``value`` (within ``by`` when given) on an aggregated frame.

    The aggregate is written once and the grand total is a scalar subquery over it, so facts are read once and no window
    pulls the frame into one task.
    """
    if by:
        total = F.sum(value).over(Window.partitionBy(*by))
    else:
        df = materialise(df)
        total = df.agg(F.sum(value)).scalar()
    return df.withColumn(out, rate(F.col(value), total, digits=digits))


def shares(df: DataFrame, columns: Mapping[str, str], digits: int = 1) -> DataFrame:
    """Several grand-total shares in one pass: ``{out: value column}``; the aggregate is computed once."""
    df = materialise(df)
    totals = df.agg(F.struct(*[F.sum(v).cast("double").alias(o) for o, v in columns.items()])).scalar()
    return df.withColumns({o: rate(F.col(v), totals[o], digits=digits) for o, v in columns.items()})


def same(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """All pairs equal, NULL to NULL as well."""
    return reduce(lambda x, y: x & y, [p.eqNullSafe(q) for p, q in zip(a, b, strict=True)])


def running_total(df: DataFrame, order: Sequence[tuple[str, bool]], sums: Mapping[str, str], by: Sequence[str] = ()) -> DataFrame:
    """Exact running sums over one global order (one order per ``by`` group when given); NULLs come last.

    ``order`` lists (column, descending) and ``sums`` maps output to summed column (a NULL adds nothing). Rows are
    dealt by ranges of all order columns, so a value that many rows share is split by the next column, and the number of
    ranges follows the session's shuffle partitions. The dealt rows are written to checkpoint storage with their range number;
    each range gets its offset from one row per range (and group), and only the window inside a range is left. Rows that tie on
    all order columns count in any order.
    """
    sort = [F.col(c).desc_nulls_last() if desc else F.col(c).asc_nulls_last() for c, desc in order]
    dealt = df.repartitionByRange(*[F.col(c).asc_nulls_last() for c in by], *sort).withColumn("_range", F.spark_partition_id())
    dealt = materialise(dealt)
    totals = dealt.groupBy(*by, "_range").agg(*[F.sum(v).alias(f"_t_{o}") for o, v in sums.items()])
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(c).alias(f"_g_{c}") for c in by], F.col("_range").alias("_r"),
                            *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_b_{o}") for o in sums])
    inside = Window.partitionBy(*by, "_range").orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0)
    run = dealt.withColumns({f"_i_{o}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for o, v in sums.items()})
    out = run.join(offsets, same([F.col("_range"), *[F.col(c) for c in by]], [F.col("_r"), *[F.col(f"_g_{c}") for c in by]]))
    return out.select(*df.columns, *[(F.col(f"_i_{o}") + F.col(f"_b_{o}")).alias(o) for o in sums])


def rank_by(df: DataFrame, ranks: Mapping[str, str]) -> DataFrame:
    """Independent descending ranks (ties share a rank, NULLs come last): ``{out: column}``.

    Each rank is computed on distinct values with their counts, so ties of any size stay one row.
    """
    df = materialise(df)
    for out, c in ranks.items():
        counts = df.groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
        upto = running_total(counts, [(c, True)], {"_upto": "_n"})
        upto = upto.select(F.col(c).alias("_value"), (F.col("_upto") - F.col("_n") + 1).cast("int").alias(out))
        df = df.join(upto, F.col(c).eqNullSafe(F.col("_value"))).drop("_value")
    return df


def pareto(df: DataFrame, key: str, value: str, digits: int = 2) -> DataFrame:
    """Aggregated rows in descending order with their share and the cumulative share of the total."""
    run = materialise(running_total(df, [(value, True), (key, False)], {"cum_value": value}))
    total = run.agg(F.sum(value)).scalar()
    return run.withColumns({
        "share_pct": rate(F.col(value), total, digits=digits),
        "cum_share_pct": rate(F.col("cum_value"), total, digits=digits),
    }).drop("cum_value")


def concentration(df: DataFrame, key: str, value: str, steps: int = 10) -> DataFrame:
    """Top x percent of keys against the share of ``value`` they hold, for ``steps`` equal cuts."""
    run = materialise(running_total(df.withColumn("_one", F.lit(1)), [(value, True), (key, False)], {"pos": "_one", "cum_value": value}))
    n = run.agg(F.count(F.lit(1))).scalar()
    total = run.agg(F.sum(value)).scalar()
    step = F.ceil(F.col("pos").cast("double") * F.lit(steps) / n).cast("int")
    g = run.groupBy(step.alias("step")).agg(F.max_by("cum_value", "pos").alias("cum_value"))
    return g.select((F.col("step") * F.lit(100.0 / steps)).alias("top_pct"),
                    rate(F.col("cum_value"), total, digits=2).alias("cum_share_pct"))


def top_k(df: DataFrame, order: Sequence[Column], k: int = 10) -> DataFrame:
    """Ordered first ``k`` rows (a per-task heap, no global sort)."""
    return df.orderBy(*order).limit(k)


def feed(df: DataFrame, where: Column | None, order: Sequence[Column], page: int = 0, size: int = 20) -> DataFrame:
    """One page of a filtered feed."""
    hit = df if where is None else df.filter(where)
    return hit.orderBy(*order).offset(page * size).limit(size)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str] | None = None) -> DataFrame:
    """The row with the highest ``order`` values per key; rows that tie on all of them are told apart by a hash of the row.

    The rank filter is applied in each task before the shuffle, so one row per key and task moves, and no strings are sorted
    unless they are in ``order``.
    """
    rest = [c for c in (keep or df.columns) if c not in keys]
    plain = [c for c in df.columns if not isinstance(df.schema[c].dataType, MapType)]
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order], F.xxhash64(*plain))
    return df.withColumn("_pos", F.row_number().over(w)).filter(F.col("_pos") == 1).select(*keys, *rest)


def last_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 10, pos: str = "recency") -> DataFrame:
    """The last ``n`` rows per key, newest first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(pos, F.row_number().over(w)).filter(F.col(pos) <= n)


def prior_events(df: DataFrame, key: str, day: str, tie: Sequence[str], flag: Column, out: str) -> DataFrame:
    """Flagged rows of the same key before this row.

    Whole earlier days come from a per-day total; only rows of one key and one day share a window,
    which splits a key that owns a large part of the table. Rows without a key form one group; a missing day
    comes after all others.
    """
    keyed = df.withColumn("_f", F.coalesce(flag.cast("long"), F.lit(0)))
    daily = keyed.groupBy(key, day).agg(F.sum("_f").alias("_d"))
    before = Window.partitionBy(key).orderBy(F.col(day).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    daily = daily.select(F.col(key).alias("_key"), F.col(day).alias("_day"), F.coalesce(F.sum("_d").over(before), F.lit(0)).alias("_before"))
    same_day = Window.partitionBy(key, day).orderBy(*tie).rowsBetween(Window.unboundedPreceding, -1)
    within = keyed.withColumn("_within", F.coalesce(F.sum("_f").over(same_day), F.lit(0)))
    joined = within.join(daily, same([F.col(key), F.col(day)], [F.col("_key"), F.col("_day")]))
    return joined.withColumn(out, F.col("_before") + F.col("_within")).drop("_f", "_key", "_day", "_before", "_within")


def baseline_z(df: DataFrame, keys: Sequence[str], day: str, value: str, days: int = 30) -> DataFrame:
    """Trailing mean, deviation and z-score of a daily series against the ``days`` before each day.

    ``df`` has one row per key and day. Days without a row count as zero, so mean and (sample)
    variance come from windowed sums over the fixed length. ``history_days`` is the span since the
    first day of the key.
    """
    num = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy(*keys).orderBy("_dn").rangeBetween(-days, -1)
    first = Window.partitionBy(*keys)
    v = F.col(value).cast("double")
    out = df.withColumn("_dn", num).withColumns({
        "_s": F.coalesce(F.sum(v).over(w), F.lit(0.0)),
        "_q": F.coalesce(F.sum(v * v).over(w), F.lit(0.0)),
        "history_days": (F.col("_dn") - F.min("_dn").over(first)).cast("int"),
    })
    mean = F.col("_s") / F.lit(float(days))
    var = F.greatest((F.col("_q") - F.col("_s") * F.col("_s") / F.lit(float(days))) / F.lit(float(days - 1)), F.lit(0.0))
    out = out.withColumns({"base_mean": mean, "base_std": F.sqrt(var)})
    return out.withColumn("z", F.try_divide(v - F.col("base_mean"), F.col("base_std"))).drop("_dn", "_s", "_q")


def diversify(df: DataFrame, source: str, newest: Sequence[Column], size: int = 20, cap: int = 3, pull: int = 4) -> DataFrame:
    """First feed page with at most ``cap`` rows per source.

    Takes the newest ``pull * size`` rows, then deals them out source by source.
    """
    pool = df.orderBy(*newest).limit(pull * size)
    w = Window.partitionBy(source).orderBy(*newest)
    dealt = pool.withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= cap)
    return dealt.orderBy("turn", *newest).limit(size)


def at_or_above_fraction(df: DataFrame, score: str, frac: float) -> Column:
    """The lowest score inside the top ``frac`` of rows (ties at the edge belong to it), as a scalar."""
    counts = df.filter(F.col(score).isNotNull()).groupBy(score).agg(F.count(F.lit(1)).alias("_n"))
    run = running_total(counts, [(score, True)], {"_upto": "_n"})
    n = run.agg(F.sum("_n")).scalar()
    inside = run.filter(F.col("_upto") - F.col("_n") < F.ceil(n * F.lit(frac)))
    return inside.agg(F.min(score)).scalar()


def top_fraction(df: DataFrame, score: str, frac: float) -> DataFrame:
    """Rows in the top ``frac`` by score, including ties at the edge; no global sort of the rows."""
    return df.filter(F.col(score) >= at_or_above_fraction(df, score, frac))
