"""Date-key and age expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .metrics import col


def date_key(d: Column | str) -> Column:
    """Integer ``YYYYMMDD`` key of a date."""
    return F.date_format(col(d), "yyyyMMdd").cast("int")


def key_to_date(key: Column | str) -> Column:
    """Date of a ``YYYYMMDD`` key; NULL for the unset key 0 and for malformed keys."""
    return F.try_to_date(F.nullif(col(key), F.lit(0)).cast("string"), "yyyyMMdd")


def shift_key(key: Column | str, days: Column | int, lo: dt.date, hi: dt.date) -> Column:
    """Move a key by days and clamp it to the calendar range."""
    shift = F.lit(days) if isinstance(days, int) else days
    moved = F.date_add(key_to_date(key), shift)
    return date_key(F.least(F.greatest(moved, F.lit(lo)), F.lit(hi)))


def age_days(d: Column | str, as_of: dt.date | str) -> Column:
    return F.datediff(F.lit(as_of).cast("date"), col(d))


def month_start(d: Column | str) -> Column:
    return F.trunc(col(d), "MM")


def period_label(d: Column | str) -> Column:
    return F.date_format(col(d), "yyyy-MM")
