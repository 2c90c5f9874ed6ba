"""Writers: overwrite, refresh, upsert, unique ingest, dated snapshots, metrics."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlens.functions.textual import content_hash
from bizlens.operators.ordering import latest_per_key
from bizlens.session import materialise


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = (), fmt: str = "parquet") -> None:
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """A handful of metric rows as JSON."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def refresh(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Replace the table, or only the partitions present in ``df``; running it twice changes nothing."""
    if not partition_by:
        df.write.mode("overwrite").parquet(path)
        return
    # Rows of a partition are brought together for few files; AQE splits a partition that is too large for one task.
    rows = df.hint("rebalance", *partition_by)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def upsert(base: DataFrame, delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``base`` with the rows of ``delta`` put in place by key; the delta wins.

    A key that the delta repeats with different rows has no newest row; one of them is taken by a hash of the row, so a repeated run
    gives the same table. Give the delta one row per key (for example by ``latest_per_key``) where the order matters.
    """
    marked = base.withColumn("_new", F.lit(0)).unionByName(delta.withColumn("_new", F.lit(1)))
    return latest_per_key(marked, keys, ["_new"]).drop("_new")


def ingest_unique(incoming: DataFrame, cols: Sequence[str], key: str, store: DataFrame | None = None) -> DataFrame:
    """Rows whose content hash is new, the lowest ``key`` of each; feeding the same rows again yields none.

    Only (hash, key) pairs are grouped and compared, so copies combine on the map side and no content moves for it. The
    pairs that lose are taken out by an anti join; of rows that repeat a key with its content one is kept.
    """
    hashed = incoming.withColumn("content_hash", content_hash(*cols))
    pairs = materialise(hashed.groupBy(key, "content_hash").agg(F.count(F.lit(1)).alias("_n")))
    first = pairs.groupBy("content_hash").agg(F.min(key).alias("_first"), F.count(F.lit(1)).alias("_keys")).filter("_keys > 1")
    losers = pairs.join(first, "content_hash").filter(~F.col(key).eqNullSafe(F.col("_first"))).select(key, "content_hash")
    if store is not None:
        losers = losers.union(pairs.join(store.select("content_hash"), "content_hash", "left_semi").select(key, "content_hash"))
    lost = losers.select(F.col(key).alias("_key"), F.col("content_hash").alias("_hash"))
    kept = hashed.join(lost, F.col(key).eqNullSafe(F.col("_key")) & (F.col("content_hash") == F.col("_hash")), "left_anti")
    if pairs.filter("_n > 1").isEmpty():
        return kept
    return kept.dropDuplicates([key, "content_hash"])


def commit_snapshot(plan: DataFrame, path: str, by: str = "system", as_of: dt.date | None = None) -> None:
    """Append the plan as a dated snapshot; earlier snapshots are never touched."""
    day = F.lit(as_of) if as_of else F.current_date()
    rows = plan.withColumns({
        "snapshot_id": F.expr("uuid()"),
        "snapshot_date": day,
        "action": F.when(F.col("production_need") > 0, F.lit("produce now")).otherwise(F.lit("watch")),
        "committed_by": F.lit(by),
    })
    rows.write.mode("append").partitionBy("snapshot_date").parquet(path)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
