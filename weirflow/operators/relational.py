"""Projection, filtering, mapping, composition. Every operator is a function from DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import get_or, zero
from .ordering import Ordered, _columns, plain

Step = Callable[[DataFrame], DataFrame]


def map_columns(df: DataFrame, **columns: Column) -> DataFrame:
    """One row for each row, made of the given expressions alone."""
    return df.select(*(c.alias(n) for n, c in columns.items()))


def map_batches(df: DataFrame, fn, schema: str) -> DataFrame:
    """Opaque code over Arrow batches (an iterator of pyarrow.RecordBatch); for what expressions can't say."""
    return df.mapInArrow(fn, schema)


def where(df: DataFrame, condition: Column) -> DataFrame:
    return df.filter(condition)


def select(df: DataFrame, *fields: str) -> DataFrame:
    """The fields that exist, in the given order; others are skipped."""
    return df.select(*(F.col(f"`{f}`") for f in fields if f in df.columns))


def update(df: DataFrame, **columns: Column) -> DataFrame:
    """Rows with fields set; all expressions see the old row."""
    return df.withColumns(columns)


def extract_field(df: DataFrame, field: str, to: str) -> DataFrame:
    """A column `value` of one type; missing or unconvertible values become its zero value."""
    return df.select(get_or(df, field, zero(T._parse_datatype_string(to)), to).alias("value"))


def flat_map(df: DataFrame, array: Column, name: str = "value", position: str | None = None) -> DataFrame:
    """A row for each element of an array expression; rows with an empty array vanish."""
    return df.select("*", F.posexplode(array).alias(position, name)) if position else df.select("*", F.explode(array).alias(name))


def limit(df: DataFrame, n: int, order_by) -> DataFrame:
    """The first n rows in order; none if n is not positive."""
    return df.orderBy(*_columns(order_by)).limit(max(n, 0))


def offset(df: DataFrame, n: int, order_by) -> DataFrame:
    """Without the first n rows in order, sorted: rows are numbered by blocks of the order, so no task sees all of them."""
    order = _columns(order_by)
    if n <= 0:
        return df.orderBy(*order)
    rows = plain(Ordered(df, order).prefix(_rn=("count", F.lit(1))))
    return rows.where(F.col("_rn") > n).drop("_rn").orderBy(*order)


def pipe(*steps: Step) -> Step:
    return lambda df: reduce(DataFrame.transform, steps, df)


def chain(df: DataFrame, *steps: Step) -> DataFrame:
    return reduce(DataFrame.transform, steps, df)


def parallel(df: DataFrame, workers: int, step: Step) -> DataFrame:
    """step over rows dealt to so many tasks, in no order."""
    return step(df.repartition(workers))


def tee(df: DataFrame, n: int, keep: bool = False) -> list[DataFrame]:
    """The same rows n times, none lost however far one reader is ahead. keep: computed once and held (memory, then disk)."""
    df = df.persist() if keep else df
    return [df] * n


def split(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by key, all groups whole; the column group is the struct of the typed keys (NULL is a key of its own).

    Per-group code: per_group(), or groupBy("group").
    """
    return df.withColumn("group", F.struct(*keys)).repartition(*keys)


def split_write(df: DataFrame, path: str, *keys: str) -> None:
    """A folder for each key."""
    df.repartition(*keys).write.partitionBy(*keys).parquet(path)


def per_group(df: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    """Opaque code over each group as a pandas DataFrame; a group must fit in a task's memory."""
    return df.groupBy(*keys).applyInPandas(fn, schema)


@contextmanager
def cancellable(spark: SparkSession, tag: str):
    """Jobs that this thread starts inside can be cancelled from another thread, by calling what is yielded."""
    context = spark.sparkContext
    context.addJobTag(tag)
    try:
        yield lambda: context.cancelJobsWithTag(tag)
    finally:
        context.removeJobTag(tag)
