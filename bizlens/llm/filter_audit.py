"""Filter interaction audit by incremental retraction streaming.

Five document filters are judged on whole texts (null counts as empty; words are maximal runs of bytes other than
0x20 and 0x09-0x0D, case-sensitive). A document fails

* A: with fewer than 100 words;
* B: when ``100 * distinct words < 80 * words``;
* C: when ``100 * [A-Z] characters > 10 * code points``;
* D: when it holds any of ``# $ % & * |``;
* E: when a row with a smaller id has the identical text, anywhere in the table, removed or not.

A to D are row-wise. E needs the least id of each text over the whole table: the documents are read as a stream of
available-now micro-batches, and a state per text (its least id so far, and the rows that hold it) is kept in a
map state of ``transformWithStateInPandas``, grouped by a hash bucket of the text so that one call serves many texts. Rows above the least id fail E at once; when a smaller id arrives, the rows that held the
least id are retracted from the counters of their part and mask and counted again with E. Each input partition is
summed per text before the state is reached, so a text with thousands of copies sends a few rows per partition.

The stream writes signed changes of (part, mask, good, toxic) counters; their sums are the 32-mask histogram of each
part, from which every order of the five filters is reported.
"""

from __future__ import annotations

import itertools
import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from bizlens.session import scratch_path

LETTERS = "ABCDE"
E = 16
ROWS = "text_key string, part string, mask int, good int, toxic int, n_ids long, min_id long, n_at_min long, n_null long"
ROW_COLUMNS = [c.split()[0] for c in ROWS.split(", ")]
CHANGES = "part string, mask int, good int, toxic int, delta long"
#: Groups of texts whose states one call handles; each text keeps its own entry in the map state.
BUCKETS = 1024
#: Files per micro-batch; the result does not depend on it.
FILES_PER_BATCH = 4


def masks(docs: DataFrame) -> DataFrame:
    """``text_key``, ``part``, ``doc_id`` and the bits of filters A to D (1, 2, 4, 8) of each row."""
    docs = docs.select("doc_id", "lang", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    docs = docs.withColumn("words", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    text, words = F.col("text"), F.col("words")
    n = F.size(words).cast("long")
    upper = (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))).cast("long")
    bits = (F.when(n < 100, 1).otherwise(0)
            + F.when(F.lit(100) * F.size(F.array_distinct(words)).cast("long") < F.lit(80) * n, 2).otherwise(0)
            + F.when(F.lit(100) * upper > F.lit(10) * F.length(text).cast("long"), 4).otherwise(0)
            + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text, 256).alias("text_key"),
                       F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), bits.cast("int").alias("mask"))


def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one input partition summed per text, part, mask and labels: ids counted, the least one and its rows."""
    for rows in batches:
        if rows.empty:
            continue
        keys = ["text_key", "part", "mask", "good", "toxic"]
        rows = rows.assign(has=rows["doc_id"].notna())
        least = rows.groupby(keys, dropna=False)["doc_id"].transform("min")
        rows = rows.assign(at=rows["has"] & (rows["doc_id"] == least))
        out = rows.groupby(keys, dropna=False).agg(n_ids=("has", "sum"), min_id=("doc_id", "min"), n_at_min=("at", "sum"))
        out["n_null"] = rows.groupby(keys, dropna=False).size() - out["n_ids"]
        out = out.reset_index()
        yield out.astype({"n_ids": "int64", "n_at_min": "int64", "n_null": "int64", "min_id": "Int64"})


class Retraction(StatefulProcessor):
    """Per bucket of texts, a map from each text to its least id so far and the rows that hold it (RocksDB state).

    Rows above the least id fail E at once; a smaller least id retracts the rows that held the old one and counts them
    again with E. Output: signed changes of the (part, mask, good, toxic) counters."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.texts = handle.getMapState("texts", "text_key string", "min_id long, entries string")

    def handleInputRows(self, key, rows, timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        change: Counter = Counter()
        texts: dict[str, list[tuple]] = {}
        for part in rows:  # plain tuples: a pandas group per text costs more than its state
            for text_key, *row in zip(*(part[c].tolist() for c in ROW_COLUMNS)):
                texts.setdefault(text_key, []).append(row)
        for text_key, group in texts.items():
            least, held = None, {}
            known = self.texts.getValue((text_key,))  # None for a text not seen before
            if known is not None:
                least, entries = known
                held = {tuple(e[:4]): e[4] for e in json.loads(entries)}
            before = (least, dict(held))
            for part, mask, good, toxic, n_ids, min_id, n_at_min, n_null in group:
                own, failed = (part, mask, good, toxic), (part, mask | E, good, toxic)
                change[own] += n_null
                if n_ids == 0:
                    continue
                change[failed] += n_ids - n_at_min
                low = int(min_id)
                if least is None or low < least:
                    for (p, m, g, t), c in held.items():
                        change[(p, m, g, t)] -= c
                        change[(p, m | E, g, t)] += c
                    least, held = low, {own: n_at_min}
                    change[own] += n_at_min
                elif low == least:
                    held[own] = held.get(own, 0) + n_at_min
                    change[own] += n_at_min
                else:
                    change[failed] += n_at_min
            if least is not None and (least, held) != before:
                self.texts.updateValue((text_key,), (least, json.dumps([[*k, c] for k, c in held.items()])))
        out = [(*k, c) for k, c in change.items() if c != 0]
        yield pd.DataFrame(out, columns=["part", "mask", "good", "toxic", "delta"])

    def close(self) -> None:
        pass


def changes(spark: SparkSession, documents: str, labels: DataFrame, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """Run the stream over the documents at ``documents`` (a parquet path) to its end; the written counter changes."""
    schema = spark.read.parquet(documents).schema
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"),
                          F.when(F.col("quality") == 1, 1).otherwise(0).alias("good"),
                          F.when(F.col("toxic") == 1, 1).otherwise(0).alias("toxic"))
    marks = marks.groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    path = spark._jvm.org.apache.hadoop.fs.Path(documents)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        # A stream reads folders; one file is named by a pattern that matches only itself.
        documents = f"{documents[:-1]}[{documents[-1]}]"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(documents)
    rows = masks(stream.select("doc_id", "text", "lang")).join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])
    rows = rows.select("doc_id", "text_key", "part", "mask", F.col("good").cast("int").alias("good"), F.col("toxic").cast("int").alias("toxic"))
    parts = rows.mapInPandas(summed, ROWS)
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    # no space is set aside for the files of a state store: it would add up over the many small stores of a query
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    bucketed = parts.withColumn("bucket", F.pmod(F.xxhash64("text_key"), F.lit(BUCKETS)))
    out = bucketed.groupBy("bucket").transformWithStateInPandas(Retraction(), CHANGES, "Append", "None")
    path, checkpoint = scratch_path(spark, "audit-changes"), scratch_path(spark, "audit-checkpoint")
    spark.createDataFrame([], CHANGES).write.parquet(path)
    out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint) \
        .outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(CHANGES).parquet(path)


def orders() -> list[tuple[str, int, int, int]]:
    """``(filter_order, step, bit of the step's filter, bits of the filters before it)`` for all 120 orders."""
    out = []
    for order in itertools.permutations(range(5)):
        for step, f in enumerate(order):
            out.append(("".join(LETTERS[k] for k in order), step + 1, 1 << f, sum(1 << k for k in order[:step])))
    return out


def report(change: DataFrame) -> DataFrame:
    """One row per part, order and step from the summed changes; see :func:`audit`."""
    total = change.groupBy("part", "mask", "good", "toxic").agg(F.sum("delta").alias("n"))
    hist = total.groupBy("part").agg(
        F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col("n"))), F.lit(0)).cast("long") for m in range(32)]).alias("n"),
        F.array(*[F.coalesce(F.sum(F.when((F.col("mask") == m) & (F.col("good") == 1), F.col("n"))), F.lit(0)).cast("long") for m in range(32)]).alias("g"),
        F.array(*[F.coalesce(F.sum(F.when((F.col("mask") == m) & (F.col("toxic") == 1), F.col("n"))), F.lit(0)).cast("long") for m in range(32)]).alias("t"))
    steps = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(f).alias("f"), F.lit(e).alias("earlier"))
                      for o, s, f, e in orders()])
    rows = hist.select("part", "n", "g", "t", F.explode(steps).alias("o")).select("part", "n", "g", "t", "o.*")

    def total_of(arr: str, test: str) -> F.Column:
        return F.expr(f"aggregate(sequence(0, 31), 0L, (acc, m) -> acc + IF({test}, {arr}[m], 0L))")

    removed = "(m & f) <> 0 AND (m & earlier) = 0"
    return rows.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        total_of("n", "(m & (earlier | f)) = 0").alias("kept"),
        total_of("n", removed).alias("removed"),
        total_of("n", "(m & f) <> 0 AND (m & earlier) <> 0").alias("redundant"),
        F.expr("n[f]").alias("unique_fails"),
        total_of("g", removed).alias("good_lost"),
        total_of("t", removed).alias("toxic_lost"),
        F.expr("aggregate(sequence(1, 31), 0L, (acc, m) -> acc + IF((m & f) <> 0, n[m] * (120 div bit_count(m)), 0L))").alias("shapley"))


def audit(spark: SparkSession, documents: str, labels: DataFrame, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """Per part (``lang``; null: empty string), ``filter_order`` (each of the 120 orders of ABCDE) and ``step`` (1-5):
    ``kept`` (documents left after the step), ``removed`` (removed by the step's filter), ``redundant`` (failing it,
    removed earlier), ``unique_fails`` (failing only it), ``good_lost`` and ``toxic_lost`` (removed here and marked
    ``quality = 1`` or ``toxic = 1`` in ``labels``), ``shapley`` (removed by the step's filter, summed over all
    orders). Counts are longs; every part present has all 600 rows, zeros included.

    ``documents`` is a parquet path with ``doc_id``, ``text`` and ``lang``; other columns are not read. Null text
    counts as empty. A null id never fails E and makes no other row fail it; repeated rows of one id and text do not
    fail E against each other. A document is good (toxic) if any of its label rows says so; labels of other ids are
    ignored. An empty table gives an empty result.
    """
    return report(changes(spark, documents, labels, files_per_batch))
