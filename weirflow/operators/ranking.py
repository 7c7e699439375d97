"""Ranking and offset functions over keyed windows, as columns added to the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import _columns

_FUNCTIONS = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank, "percent_rank": F.percent_rank, "cume_dist": F.cume_dist}


def rank(df: DataFrame, kind: str, keys: list[str], order_by, name: str | None = None) -> DataFrame:
    """kind: row_number, rank, dense_rank, percent_rank or cume_dist."""
    return df.withColumn(name or kind, _FUNCTIONS[kind]().over(Window.partitionBy(*keys).orderBy(*_columns(order_by))))


def ntile(df: DataFrame, n: int, keys: list[str], order_by, name: str = "ntile") -> DataFrame:
    return df.withColumn(name, F.ntile(n).over(Window.partitionBy(*keys).orderBy(*_columns(order_by))))


def lag(df: DataFrame, value: str, keys: list[str], order_by, n: int = 1, default=None, name: str = "lag") -> DataFrame:
    return df.withColumn(name, F.lag(value, n, default).over(Window.partitionBy(*keys).orderBy(*_columns(order_by))))


def lead(df: DataFrame, value: str, keys: list[str], order_by, n: int = 1, default=None, name: str = "lead") -> DataFrame:
    return df.withColumn(name, F.lead(value, n, default).over(Window.partitionBy(*keys).orderBy(*_columns(order_by))))


def nth_value(df: DataFrame, value: str, n: int, keys: list[str], order_by, name: str = "nth_value") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*_columns(order_by)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn(name, F.nth_value(value, n).over(w))


def framed(df: DataFrame, aggregate, keys: list[str], order_by, start: int, end: int, name: str, rows: bool = True) -> DataFrame:
    """aggregate: a Column such as F.sum("v"), over a frame of rows (or of the order's values, rows=False)."""
    w = Window.partitionBy(*keys).orderBy(*_columns(order_by))
    return df.withColumn(name, aggregate.over(w.rowsBetween(start, end) if rows else w.rangeBetween(start, end)))
