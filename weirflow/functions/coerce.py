"""Typed access to loosely typed fields: conversions that give NULL instead of failing, defaults, times.

Deliberate choices where loosely typed engines differ: integers become decimal text (not a code point), text becomes a
boolean by its words (not by being non-empty), and text converts to every numeric type by one rule: an optional sign and
digits (with a fraction or exponent for floating point), no surrounding white space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_ZERO = {T.StringType: "", T.BooleanType: False}
_INT_TEXT = r"^[+-]?[0-9]+$"
_FLOAT_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_TRUE, _FALSE = ("true", "t", "yes", "y"), ("false", "f", "no", "n")
_TIME_TEXT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?$"


def dtype(df: DataFrame, field: str) -> T.DataType | None:
    """The field's type, None if there is no such field; dots step into structs."""
    try:
        return df.select(F.col(field)).schema[0].dataType
    except Exception as e:  # analysis errors differ by Spark version
        if "UNRESOLVED_COLUMN" in str(e) or "FIELD_NOT_FOUND" in str(e):
            return None
        raise


def zero(to: T.DataType) -> Column:
    return F.lit(_ZERO.get(type(to), 0)).cast(to)


def convert(value: Column, source: T.DataType, to: T.DataType) -> Column:
    """value as the type, NULL where it doesn't convert. Fractions are cut off towards zero."""
    if isinstance(to, T.StringType):
        return value.cast("string")
    if isinstance(to, (T.TimestampType, T.TimestampNTZType)):
        return parse_time(value, source).cast(to)
    if isinstance(source, T.StringType):
        if isinstance(to, T.BooleanType):
            return parse_bool(value)
        if isinstance(to, _INTEGRAL):
            return F.when(value.rlike(_INT_TEXT), value.try_cast(to))
        return F.when(value.rlike(_FLOAT_TEXT), value.try_cast(to))
    return value.try_cast(to)


def get(df: DataFrame, field: str, to: T.DataType | str) -> Column:
    """The field converted; NULL if it is missing or doesn't convert."""
    to = T._parse_datatype_string(to) if isinstance(to, str) else to
    source = dtype(df, field)
    return F.lit(None).cast(to) if source is None else convert(F.col(field), source, to)


def get_or(df: DataFrame, field: str, default: Column | object, to: T.DataType | str) -> Column:
    to = T._parse_datatype_string(to) if isinstance(to, str) else to
    return F.coalesce(get(df, field, to), (default if isinstance(default, Column) else F.lit(default)).cast(to))


def has(df: DataFrame, field: str) -> bool:
    return field in df.columns


def parse_bool(text: Column) -> Column:
    word = F.lower(text)
    return F.when(word.isin(*_TRUE, "1"), True).when(word.isin(*_FALSE, "0"), False)


def parse_time(value: Column, source: T.DataType) -> Column:
    """Timestamps as they are, integers as Unix seconds, text as RFC 3339 or date and time with a blank or T; dates alone don't count."""
    if isinstance(source, (T.TimestampType, T.TimestampNTZType)):
        return value
    if isinstance(source, _INTEGRAL):
        return F.timestamp_seconds(value)
    if isinstance(source, T.StringType):
        return F.when(value.rlike(_TIME_TEXT), F.try_to_timestamp(value))
    return F.lit(None).cast("timestamp")


def standardize_time(ts: Column, like: T.DataType | None = None) -> Column:
    """Rounded to the nearest second, halves up."""
    out = F.date_trunc("second", ts + F.expr("INTERVAL 500 MILLISECONDS"))
    return out.cast(like) if like is not None else out


def cell_kind(cell: Column) -> Column:
    """What one CSV cell looks like: empty, bool, int, float, time or string."""
    cell = F.trim(cell)
    time = cell.rlike(_TIME_TEXT) | cell.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") | cell.rlike(r"^[0-9]{2}:[0-9]{2}:[0-9]{2}$")
    return F.when(cell.isNull() | (cell == ""), "empty").when(F.lower(cell).isin(*_TRUE, *_FALSE), "bool").when(cell.rlike(_INT_TEXT), F.when(cell.try_cast("bigint").isNotNull(), "int").otherwise("float")).when(cell.rlike(_FLOAT_TEXT), "float").when(time & F.try_to_timestamp(cell).isNotNull(), "time").otherwise("string")


def infer_cells(df: DataFrame) -> dict[str, str]:
    """The narrowest type that all cells of a text column share, in one pass over the rows: bool, bigint, double, timestamp or string."""
    kinds = df.agg(*(F.collect_set(cell_kind(F.col(f"`{c}`"))).alias(str(i)) for i, c in enumerate(df.columns))).head()
    out = {}
    for i, c in enumerate(df.columns):
        seen = set(kinds[i]) - {"empty"}
        out[c] = {"bool": "boolean", "int": "bigint", "float": "double", "time": "timestamp"}.get(seen.pop(), "string") if len(seen) == 1 else "double" if seen == {"int", "float"} else "string"
    return out


def typed_cells(df: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """Text columns typed by infer_cells() or by the given types; text is trimmed, empty cells of other types become NULL."""
    types = types or infer_cells(df)
    text = T.StringType()
    cast = {"boolean": parse_bool, "timestamp": F.try_to_timestamp}
    return df.select(*(cast.get(types[c], lambda v, c=c: v if types[c] == "string" else convert(v, text, T._parse_datatype_string(types[c])))(F.trim(F.col(f"`{c}`"))).alias(c) for c in df.columns))
