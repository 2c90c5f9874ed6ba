"""Table readers with explicit schemas."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv",
               coerce: Iterable[str] = (), date_keys: Iterable[str] = (), strict: bool = False) -> DataFrame:
    """Read a table against its schema.

    ``coerce`` columns turn unreadable values into NULL; every other CSV column keeps literal
    tokens such as ``NA``. ``date_keys`` columns lose the unset key 0. ``strict`` fails on
    a malformed row.
    """
    if fmt != "csv":
        df = spark.read.schema(schema).format(fmt).load(path)
    else:
        loose = set(coerce)
        raw = T.StructType([T.StructField(f.name, T.StringType() if f.name in loose else f.dataType) for f in schema])
        df = (spark.read.schema(raw).option("header", True).option("encoding", "UTF-8")
              .option("enforceSchema", False).option("emptyValue", "").option("dateFormat", "yyyy-MM-dd")
              .option("mode", "FAILFAST" if strict else "PERMISSIVE").csv(path))
        df = df.withColumns({f.name: F.col(f.name).try_cast(f.dataType) for f in schema if f.name in loose})
    keys = list(date_keys)
    return df.withColumns({k: F.nullif(F.col(k), F.lit(0)) for k in keys}) if keys else df


def load_star(spark: SparkSession, folder: str, tables: Mapping[str, T.StructType], fmt: str = "csv",
              coerce: Mapping[str, Sequence[str]] | None = None,
              date_keys: Mapping[str, Sequence[str]] | None = None, views: bool = False) -> dict[str, DataFrame]:
    """Read every table of a star from one folder; ``views`` also registers them by name."""
    coerce, date_keys = coerce or {}, date_keys or {}
    suffix = ".csv" if fmt == "csv" else ".parquet" if fmt == "parquet" else ""
    star = {
        name: read_table(spark, f"{folder.rstrip('/')}/{name}{suffix}", schema, fmt,
                         coerce.get(name, ()), date_keys.get(name, ()))
        for name, schema in tables.items()
    }
    if views:
        register_views(star)
    return star


def register_views(tables: Mapping[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def rename_by_header(df: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """Pick columns by header text, whatever their position: ``{canonical: [headers]}``."""
    found = {}
    by_text = {c.strip().lower(): c for c in df.columns}
    for canonical, names in aliases.items():
        hits = [by_text[n.strip().lower()] for n in [canonical, *names] if n.strip().lower() in by_text]
        if not hits:
            raise ValueError(f"no column for {canonical!r}; looked for {[canonical, *names]}")
        found[canonical] = hits[0]
    return df.select(*[F.col(f"`{source}`").alias(canonical) for canonical, source in found.items()])


def inline_table(spark: SparkSession, rows: Sequence[tuple], ddl: str) -> DataFrame:
    """A small constant table as a plan literal: its size is known, so joins may broadcast it."""
    fields = T.StructType.fromDDL(ddl).fields
    structs = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, fields)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))
