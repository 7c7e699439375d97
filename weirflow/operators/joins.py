"""Equi-joins with a fixed output schema.

NULL keys match nothing unless null_safe is set; rows without a match stay on the outer sides, whatever their key. Keys are
compared by type, numbers of different types by value; a number and a text don't match (cast one side where they should).
A column name that both sides have is prefixed on both, on every row, key columns included.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Internal column: set where a row has a right side.
MATCHED = "_has_right"


def _renamed(df: DataFrame, names: set[str], prefix: str, dot: str) -> tuple[DataFrame, dict[str, str]]:
    new = {c: f"{prefix}{dot}{c}" if c in names else c for c in df.columns}
    return df.toDF(*new.values()), new


#: Bytes up to which a counted right side is broadcast.
SMALL_BYTES = 32 << 20


def _width(df: DataFrame) -> Column:
    """The bytes of a row, about: variable columns by their text, others by their size."""
    fixed = lambda t: isinstance(t, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))
    parts = [F.lit(8) if fixed(f.dataType) else F.coalesce(F.octet_length(F.col(f"`{f.name}`") if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.to_json(F.struct(f"`{f.name}`"))), F.lit(0)) for f in df.schema]
    return reduce(lambda a, b: a + b, parts, F.lit(16)).cast("long")


def is_small(df: DataFrame, rows: int, size: int = SMALL_BYTES) -> bool:
    """Whether df has at most so many rows and bytes: it reads rows + 1 rows at most."""
    n, total = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(_width(df)), F.lit(0))).head()
    return n <= rows and total <= size


def join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner", prefixes: tuple[str, str] = ("left", "right"), dot: str = ".", null_safe: bool = False, small_right_rows: int | None = None) -> DataFrame:
    """how: inner, left, right or full. prefixes: ("", "") lets the right column replace the left one of the same name.

    small_right_rows: if the right side is counted to have at most so many rows, and these at most SMALL_BYTES, it is
    broadcast; otherwise Spark decides by statistics and splits skewed keys at run time.
    """
    kinds = [d.schema[k].dataType for d, k in ((left, left_key), (right, right_key))]
    if isinstance(kinds[0], T.StringType) != isinstance(kinds[1], T.StringType):
        raise TypeError(f"keys of {kinds[0].simpleString()} and {kinds[1].simpleString()} don't compare: cast one side")
    clash = set(left.columns) & set(right.columns)
    bare = prefixes[0] == "" or prefixes[1] == ""
    l, ln = _renamed(left, clash, "_left" if bare else prefixes[0], "_" if bare else dot)
    r, rn = _renamed(right, clash, "_right" if bare else prefixes[1], "_" if bare else dot)
    if bare:
        r = r.withColumn(MATCHED, F.lit(True))
    if small_right_rows is not None and is_small(right, small_right_rows):
        r = F.broadcast(r)
    a, b = l[f"`{ln[left_key]}`"], r[f"`{rn[right_key]}`"]
    out = l.join(r, a.eqNullSafe(b) if null_safe else a == b, how)
    if not bare:
        return out
    # The right value replaces the left one on rows that have a right side.
    made = [F.when(F.col(MATCHED), F.col(f"`{rn[c]}`")).otherwise(F.col(f"`{ln[c]}`")).alias(c) if c in clash else F.col(f"`{c}`") for c in left.columns]
    return out.select(*made, *(F.col(f"`{c}`") for c in right.columns if c not in clash))


def inner_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, **options) -> DataFrame:
    return join(left, right, left_key, right_key, "inner", **options)


def left_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, **options) -> DataFrame:
    return join(left, right, left_key, right_key, "left", **options)


def right_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, **options) -> DataFrame:
    return join(left, right, left_key, right_key, "right", **options)


def full_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, **options) -> DataFrame:
    return join(left, right, left_key, right_key, "full", **options)
