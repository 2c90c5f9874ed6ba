"""Calendar dimension."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlens.functions.dates import date_key


def dim_date(spark: SparkSession, start: dt.date | str, end: dt.date | str) -> DataFrame:
    """One row per day of the closed range."""
    days = spark.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date"))
    return with_date_parts(days, "date")


def with_date_parts(df: DataFrame, day: str) -> DataFrame:
    d = F.col(day)
    return df.select(
        date_key(d).alias("date_key"), d.alias("date"), F.year(d).alias("year"), F.quarter(d).alias("quarter"),
        F.month(d).alias("month"), F.date_format(d, "MMMM").alias("month_name"), F.weekofyear(d).alias("week_of_year"),
        F.date_format(d, "EEEE").alias("day_of_week"), (F.weekday(d) < 5).alias("is_business_day"))
