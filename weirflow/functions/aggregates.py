"""Named aggregation specs, multi-aggregates and grouping.

By default a field that is missing or doesn't convert counts as zero (and so in averages, minima and maxima); missing="skip"
leaves it out. Over no rows sums, counts, averages, minima and maxima are zero values, not NULL. All numeric types, text,
booleans and times work in minima and maxima. One agg() computes any number of specs in one pass, with partial sums before
the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .coerce import convert, dtype, zero


@dataclass(frozen=True)
class Spec:
    """build: from the DataFrame to an aggregate Column."""

    name: str
    build: Callable[[DataFrame], Column]


def _value(df: DataFrame, field: str, missing: str, numeric: bool) -> tuple[Column, T.DataType]:
    kind = dtype(df, field)
    if kind is None:
        kind = T.LongType()
        return (zero(kind) if missing == "zero" else F.lit(None).cast(kind)), kind
    value, to = F.col(field), kind
    if numeric and not isinstance(kind, T.NumericType):
        to = T.DoubleType()
        value = convert(value, kind, to)
    if isinstance(to, (T.TimestampType, T.TimestampNTZType, T.DateType)) or missing == "skip":
        return value, to
    return F.coalesce(value, zero(to)), to


def _or_zero(value: Column, kind: T.DataType) -> Column:
    return value if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else F.coalesce(value, zero(kind))


def sum_field(name: str, field: str, missing: str = "zero") -> Spec:
    def build(df: DataFrame) -> Column:
        value, kind = _value(df, field, missing, True)
        return F.coalesce(F.sum(value), F.lit(0))

    return Spec(name, build)


def avg_field(name: str, field: str, missing: str = "zero") -> Spec:
    return Spec(name, lambda df: F.coalesce(F.avg(_value(df, field, missing, True)[0]).cast("double"), F.lit(0.0)))


def min_field(name: str, field: str, missing: str = "zero") -> Spec:
    def build(df: DataFrame) -> Column:
        value, kind = _value(df, field, missing, False)
        return _or_zero(F.min(value), kind)

    return Spec(name, build)


def max_field(name: str, field: str, missing: str = "zero") -> Spec:
    def build(df: DataFrame) -> Column:
        value, kind = _value(df, field, missing, False)
        return _or_zero(F.max(value), kind)

    return Spec(name, build)


def count_field(name: str, field: str | None = None) -> Spec:
    """Counts rows, whatever the field holds."""
    return Spec(name, lambda df: F.count(F.lit(1)))


def sum_stream(name: str, value: str = "value") -> Spec:
    return sum_field(name, value)


def count_stream(name: str) -> Spec:
    return count_field(name)


def min_stream(name: str, value: str = "value") -> Spec:
    return min_field(name, value)


def max_stream(name: str, value: str = "value") -> Spec:
    return max_field(name, value)


def avg_stream(name: str, value: str = "value") -> Spec:
    return avg_field(name, value)


def sum_of(name: str, extract: Column) -> Spec:
    return Spec(name, lambda df: F.coalesce(F.sum(extract), F.lit(0)))


def min_of(name: str, extract: Column) -> Spec:
    return Spec(name, lambda df: _or_zero(F.min(extract), df.select(extract).schema[0].dataType))


def max_of(name: str, extract: Column) -> Spec:
    return Spec(name, lambda df: _or_zero(F.max(extract), df.select(extract).schema[0].dataType))


def avg_of(name: str, extract: Column) -> Spec:
    return Spec(name, lambda df: F.coalesce(F.avg(extract).cast("double"), F.lit(0.0)))


def column_spec(name: str, aggregate: Column) -> Spec:
    """Any built-in aggregate, such as count_if, product or collect_set: partial sums before the shuffle."""
    return Spec(name, lambda df: aggregate)


#: With a merge step, so many values are folded at a time, and so many folds merged, up to 2^32 values.
FAN, FAN_LEVELS = 16, 8


def custom_fold(name: str, value: Column, order: Column, initial: Column, accumulate: Callable[[Column, Column], Column], finalize: Callable[[Column], Column] | None = None, merge: Callable[[Column, Column], Column] | None = None) -> Spec:
    """A fold without built-in aggregates: a group's values are gathered in order and folded in the JVM.

    One task holds a group's values, so this is for groups that fit in memory; use column_spec where a built-in does it. A
    state that grows (a text) is copied at every value: with merge, which joins the folds of neighbours, the earlier one
    first, it is copied a few times at each of a few levels. The initial value must then be neutral.
    """

    def folded(values: Column, first: Column, step: Callable[[Column, Column], Column]) -> Column:
        """The folds of FAN values at a time; one of no values."""
        pieces = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(values) / FAN).cast("int") - 1, F.lit(0)))
        return F.transform(pieces, lambda i: F.aggregate(F.slice(values, i * FAN + 1, FAN), first, step))

    def build(df: DataFrame) -> Column:
        gathered = F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"])
        if merge:
            # One array in another is a name for it: it is made once.
            pieces = F.transform(F.array(gathered), lambda values: folded(values, initial, accumulate))[0]
            whole = F.aggregate(F.sequence(F.lit(1), F.lit(FAN_LEVELS - 1)), pieces, lambda done, _: F.when(F.size(done) > 1, folded(done, initial, merge)).otherwise(done))[0]
            return F.transform(F.array(whole), finalize)[0] if finalize else whole
        return F.aggregate(gathered, initial, accumulate, finalize) if finalize else F.aggregate(gathered, initial, accumulate)

    return Spec(name, build)


def aggregates(df: DataFrame, *specs: Spec) -> DataFrame:
    """One row with a column for each spec; without specs one row without fields (a NULL column named empty)."""
    return df.agg(*(s.build(df).alias(s.name) for s in specs)) if specs else df.sparkSession.range(1).select(F.lit(None).cast("string").alias("empty"))


def group_by(df: DataFrame, keys: list[str], *specs: Spec) -> DataFrame:
    """One row for each combination of keys (typed, NULL is a key of its own). Without specs the distinct keys; without keys and rows no row."""
    if not keys:
        return aggregates(df, *specs, count_field("_rows")).where("_rows > 0").drop("_rows")
    if not specs:
        return df.select(*keys).distinct()
    return df.groupBy(*keys).agg(*(s.build(df).alias(s.name) for s in specs))


def aggregate_scalar(df: DataFrame, spec: Spec) -> object:
    """The value of one spec, as a Python object."""
    return aggregates(df, spec).head()[0]


def running_group_summary(df: DataFrame, keys: list[str], interval: int, order_by: str) -> DataFrame:
    """After every `interval` rows in order: total_processed, active_groups, largest_group_key, largest_group_count.

    Rows that tie in the order come by their keys. Of equal counts the key that reached the count first is the largest; a
    last, incomplete interval gives no row. The label of a key is its text (NULL for a NULL key), that of several keys a JSON
    array of theirs, so different keys have different labels.

    Rows are numbered within blocks of the order (see operators.ordering). What a block gives is a count for each of its
    keys, so neither all rows nor those of a hot key meet in one task; the largest count up to a row only grows, so prefix
    maxima do the rest.
    """
    from ..operators.ordering import BLOCK, Ordered

    if interval <= 0:
        raise ValueError("interval must be positive")
    text = [F.col(k).cast("string") for k in keys]
    label = text[0] if len(keys) == 1 else F.to_json(F.array(*text))
    named = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(F.col(order_by).alias("ord"), label.alias("key"), *(F.col(k).alias(n) for k, n in zip(keys, named, strict=True)))
    o = Ordered(rows, [F.col("ord"), *(F.col(n) for n in named)])
    counts = o.rows.groupBy(BLOCK, *named).agg(F.count(F.lit(1)).alias("_c"))
    earlier = Window.partitionBy(*named).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col(BLOCK).alias("_b"), *(F.col(n).alias(f"{n}_") for n in named), F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(BLOCK, *named).orderBy("ord"))
    same = (F.col(BLOCK) == F.col("_b")) & reduce(lambda x, y: x & y, (F.col(n).eqNullSafe(F.col(f"{n}_")) for n in named))
    o.rows = o.rows.withColumn("_own", own).join(counts, same).withColumn("c", F.col("_before") + F.col("_own")).select("ord", "key", *named, BLOCK, "c")
    o.rows = o.rows.withColumn("_at", F.row_number().over(o.within()))
    best = F.struct("c", (-F.col(BLOCK)).alias("b"), (-F.col("_at")).alias("n"), "key")
    out = o.prefix(n=("count", F.lit(1)), best=("max", best), active=("sum", (F.col("c") == 1).cast("long")))
    return out.where(F.col("n") % interval == 0).select(F.col("n").alias("total_processed"), F.col("active").alias("active_groups"), F.col("best.key").alias("largest_group_key"), F.col("best.c").alias("largest_group_count"))
