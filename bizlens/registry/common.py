"""Shared by the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bizlens.sources.warehouse import Warehouse


def q(fn: Callable[[Warehouse], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A registered query from a function of the warehouse."""
    return lambda spark, folder: fn(Warehouse(spark, folder))
