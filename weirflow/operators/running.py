"""Running aggregates: one value for each row, over all rows up to it in order (within keys, if given)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import Ordered, _columns, plain


def _running(df: DataFrame, kinds: dict[str, tuple[str, Column]], order_by, keys: list[str] | None) -> DataFrame:
    if keys:
        w = Window.partitionBy(*keys).orderBy(*_columns(order_by)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        agg = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
        return df.select("*", *(agg[k](e).over(w).alias(n) for n, (k, e) in kinds.items()))
    return plain(Ordered(df, _columns(order_by)).prefix(**kinds))


def running_sum(df: DataFrame, value: str, order_by, keys: list[str] | None = None, name: str = "running_sum") -> DataFrame:
    return _running(df, {name: ("sum", F.col(value))}, order_by, keys)


def running_count(df: DataFrame, order_by, keys: list[str] | None = None, name: str = "running_count") -> DataFrame:
    return _running(df, {name: ("count", F.lit(1))}, order_by, keys)


def running_min(df: DataFrame, value: str, order_by, keys: list[str] | None = None, name: str = "running_min") -> DataFrame:
    return _running(df, {name: ("min", F.col(value))}, order_by, keys)


def running_max(df: DataFrame, value: str, order_by, keys: list[str] | None = None, name: str = "running_max") -> DataFrame:
    return _running(df, {name: ("max", F.col(value))}, order_by, keys)


def running_avg(df: DataFrame, value: str, order_by, keys: list[str] | None = None, name: str = "running_avg") -> DataFrame:
    out = _running(df, {"_s": ("sum", F.col(value).cast("double")), "_c": ("count", F.col(value))}, order_by, keys)
    return out.withColumn(name, F.col("_s") / F.col("_c")).drop("_s", "_c")


def running_stats(df: DataFrame, value: str, order_by, keys: list[str] | None = None) -> DataFrame:
    """count, sum, avg, min and max up to each row."""
    v = F.col(value)
    out = _running(df, {"count": ("count", v), "sum": ("sum", v), "min": ("min", v), "max": ("max", v)}, order_by, keys)
    return out.withColumn("avg", F.col("sum").cast("double") / F.col("count"))
