"""Shared by the operators of this package: reading, scratch tables, Arrow columns, spans of work."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bizlens.session import scratch_path

#: Bytes of text that one vectorised step inside a task holds at a time; temporaries are a few dozen times this.
STEP_BYTES = 1 << 20


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, which need not have the repository on their path."""
    sc = spark.sparkContext
    if getattr(sc, "_bizlens_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(tempfile.mkdtemp(prefix="bizlens-code-"), "bizlens_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "bizlens")):
            for name in names:
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), root))
    sc.addPyFile(path)
    sc._bizlens_shipped = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once below the shared scratch folder and read it back: lineage ends here, on storage all nodes see."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null counts as empty), as ``doc_id`` and ``text``; other columns cannot clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and its n+1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def spans(offsets: np.ndarray, step: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``step`` bytes each; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + step, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, every other byte as it is."""
    upper = (data >= 65) & (data <= 90)
    return data + (upper.astype(np.uint8) << 5)


def is_space(data: np.ndarray) -> np.ndarray:
    """Bytes 0x20 and 0x09 to 0x0D."""
    return (data == 32) | ((data >= 9) & (data <= 13))


def arrow_rows(names: Sequence[str], columns: Sequence) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=list(names))


def bounded_sample(rows: DataFrame, by: str, key: str, most: int) -> DataFrame:
    """At most ``most`` rows of each ``by`` value, picked by a hash of ``key``.

    A first cut by the hash leaves about twice as many of each value, so no value's rows meet in one task.
    """
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    every = F.greatest(F.lit(1), F.floor(F.col("_n") / F.lit(2 * most)))
    few = rows.join(counts, by).filter(F.pmod(F.xxhash64(key, F.lit(11)), every) == 0)
    order = Window.partitionBy(by).orderBy(F.xxhash64(key), key)
    return few.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= most).drop("_n", "_k")
