"""Nested records: structs to flat columns, arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_array(df: DataFrame, field: str) -> bool:
    return isinstance(df.schema[field].dataType, T.ArrayType)


def _leaves(column: Column, name: str, kind: T.DataType, sep: str):
    if isinstance(kind, T.StructType) and len(kind):
        for f in kind:
            yield from _leaves(column.getField(f.name), f"{name}{sep}{f.name}", f.dataType, sep)
    else:
        yield name, column, kind


def dot_flatten(df: DataFrame, sep: str = ".", *fields: str) -> DataFrame:
    """Struct fields as columns a{sep}b, to any depth; top-level arrays zipped by position into rows, up to the shortest.

    fields: only these are treated; without, all. Empty arrays don't count for the shortest and give NULL; a row without
    elements stays one row. A separator "" means ".".
    """
    sep = sep or "."
    chosen = set(fields or df.columns)
    plain, arrays = [], []
    for f in df.schema:
        column = F.col(f"`{f.name}`")
        if f.name in chosen and isinstance(f.dataType, T.ArrayType):
            arrays.append(f.name)
        elif f.name in chosen:
            plain += [c.alias(n) for n, c, _ in _leaves(column, f.name, f.dataType, sep)]
        else:
            plain.append(column)
    if not arrays:
        return df.select(*plain)
    sizes = [F.when(F.size(F.col(f"`{a}`")) > 0, F.size(F.col(f"`{a}`"))) for a in arrays]
    least = F.coalesce(F.least(*sizes) if len(sizes) > 1 else sizes[0], F.lit(0))
    zipped = F.transform(F.sequence(F.lit(1), F.greatest(least, F.lit(1))), lambda i: F.struct(*(F.try_element_at(F.col(f"`{a}`"), i.cast("int")).alias(a) for a in arrays)))
    out = df.select(*plain, F.explode(zipped).alias("_zip"))
    inner = out.schema["_zip"].dataType
    rest = [F.col(f"`{c}`") for c in out.columns if c != "_zip"]
    return out.select(*rest, *(c.alias(n) for f in inner for n, c, _ in _leaves(F.col("_zip").getField(f.name), f.name, f.dataType, sep)))


def cross_flatten(df: DataFrame, *fields: str) -> DataFrame:
    """The cartesian product of the elements of the array fields (all, or the given ones); an empty array gives NULL and keeps the row."""
    for f in fields or [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType)]:
        if f in df.columns and is_array(df, f):
            df = df.withColumn(f, F.explode_outer(F.col(f"`{f}`")))
    return df
