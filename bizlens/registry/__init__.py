"""Registered queries: name -> (Spark callable, equivalent SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def all_queries() -> dict[str, tuple[Query, str | None]]:
    from bizlens.registry import gates, growth, markets, money, scoring, streams

    out: dict[str, tuple[Query, str | None]] = {}
    for module in (growth, money, scoring, markets, streams, gates):
        out.update(module.QUERIES)
    return out
