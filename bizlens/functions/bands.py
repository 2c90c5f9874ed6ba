"""Recoding, banding and flag expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .metrics import col


def in_set(c: Column | str, values: Iterable) -> Column:
    return col(c).isin(list(values))


def recode(c: Column | str, groups: Mapping[str, Iterable], default: str | None = None) -> Column:
    """Name the set a value belongs to: ``{label: values}``."""
    out = F.lit(default).cast("string")
    for label, values in reversed(list(groups.items())):
        out = F.when(in_set(c, values), F.lit(label)).otherwise(out)
    return out


def band_when(c: Column | str, cuts: Sequence[float], labels: Sequence[str]) -> Column:
    """Band by descending lower bounds: the first ``cut`` with ``value >= cut`` names the band.

    ``labels`` holds one entry more than ``cuts``; the last is for values below every cut.
    """
    if len(labels) != len(cuts) + 1:
        raise ValueError("labels must have one entry more than cuts")
    value = col(c)
    out = F.lit(labels[-1])
    for cut, label in reversed(list(zip(cuts, labels))):
        out = F.when(value >= F.lit(cut), F.lit(label)).otherwise(out)
    return F.when(value.isNotNull(), out)


def step_points(c: Column | str, steps: Sequence[tuple[float, int]], otherwise: int, at_most: bool = False) -> Column:
    """Points of the first step reached (``>=`` by default, ``<=`` with ``at_most``); NULL scores ``otherwise``."""
    value = col(c)
    out = F.lit(otherwise)
    for bound, points in reversed(list(steps)):
        hit = value <= F.lit(bound) if at_most else value >= F.lit(bound)
        out = F.when(hit, F.lit(points)).otherwise(out)
    return out


def rag(c: Column | str, red: float, green: float) -> Column:
    """Traffic light for a rate: below ``red``, from ``green`` on, or between."""
    value = col(c)
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(value < F.lit(red), F.lit("red"))
        .when(value >= F.lit(green), F.lit("green"))
        .otherwise(F.lit("amber"))
    )


def classify(prob: Column | str, threshold: float = 0.5, inclusive: bool = True) -> Column:
    value = col(prob)
    hit = value >= F.lit(threshold) if inclusive else value > F.lit(threshold)
    return hit.cast("int")


def any_signal(cols: Sequence[Column | str]) -> Column:
    """True when any of the 0/1 flags is set."""
    if len(cols) == 1:
        return col(cols[0]) == 1
    return F.greatest(*[col(c) for c in cols]) == 1


def small_n_note(n: Column | str, min_n: int = 50, note: str = "small n - directional") -> Column:
    return F.when(col(n) < F.lit(min_n), F.lit(note)).otherwise(F.lit(""))


def domain_rank(c: Column | str, order: Sequence) -> Column:
    """Position of a value in its own domain order; values outside it come last."""
    value = col(c)
    whens = reduce(
        lambda acc, kv: acc.when(value == F.lit(kv[1]), F.lit(kv[0])),
        list(enumerate(order))[1:],
        F.when(value == F.lit(order[0]), F.lit(0)),
    )
    return whens.otherwise(F.lit(len(order)))


def active_or_unknown(c: Column | str) -> Column:
    """An unset active flag counts as active."""
    return F.coalesce(col(c), F.lit(True))


def additive(points: Mapping[str, int | float]) -> Column:
    """Sum of ``flag * points``; the weights are data, not code."""
    terms = [F.coalesce(F.col(name), F.lit(0)) * F.lit(p) for name, p in points.items()]
    return reduce(lambda a, b: a + b, terms)
