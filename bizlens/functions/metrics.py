"""Aggregate and ratio expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column | str, den: Column | str) -> Column:
    """``num / den`` as a double; NULL when the denominator is zero or NULL."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def rate(num: Column | str, den: Column | str, scale: float = 100.0, digits: int | None = 2) -> Column:
    """Scaled, rounded safe ratio (percent by default)."""
    value = F.try_divide(F.lit(float(scale)) * col(num).cast("double"), col(den).cast("double"))
    return value if digits is None else F.round(value, digits)


def remainder_rate(num: Column | str, den: Column | str, digits: int = 1) -> Column:
    """``100 * (1 - num/den)``, e.g. retention from a churn count."""
    return F.round(F.lit(100.0) * (F.lit(1.0) - ratio(num, den)), digits)


def sum_if(value: Column | str, cond: Column) -> Column:
    return F.sum(F.when(cond, col(value)))


def count_if(cond: Column) -> Column:
    return F.count_if(cond)


def avg_if(value: Column | str, cond: Column) -> Column:
    return F.avg(F.when(cond, col(value)))


def any_flag(cond: Column) -> Column:
    """1 when any row of the group satisfies ``cond``, else 0."""
    return F.max(F.when(cond, F.lit(1)).otherwise(F.lit(0)))


def money(value: Column | str) -> Column:
    """Exact two-digit money, so that sums do not depend on the order of rows."""
    return col(value).cast(MONEY)


def money_sum(value: Column | str, where: Column | None = None) -> Column:
    """Order-independent money total, returned as a double."""
    v = money(value)
    return F.sum(v if where is None else F.when(where, v)).cast("double")


def money_avg(value: Column | str, where: Column | None = None) -> Column:
    """Mean from an exact sum (a decimal ``avg`` would round to six digits)."""
    v = money(value) if where is None else F.when(where, money(value))
    return F.try_divide(F.sum(v).cast("double"), F.count(v).cast("double"))


def pctl(value: Column | str, p: float, where: Column | None = None) -> Column:
    """Exact, interpolated percentile.

    The aggregate keeps one counter per distinct value of the group, so it is meant for
    columns with a small domain (whole days, months); all uses in this package are such.
    """
    v = col(value) if where is None else F.when(where, col(value))
    return F.percentile(v, F.lit(p))


def lift_ratio(value: Column, baseline: Column) -> Column:
    return F.try_divide(value, baseline)
