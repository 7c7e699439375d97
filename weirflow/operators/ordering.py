"""Order: sorting, top-k, row numbers and prefix aggregates over all rows without one task that sees them all."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Internal column: the block of the order that a row is in.
BLOCK = "_block"
#: Rows of a block, about, and the most blocks (their bounds stand in the plan); bounds come from so many sampled rows a block.
BLOCK_ROWS, MOST_BLOCKS, SAMPLED = 16_384, 8_192, 16


def _order_parts(c: Column) -> tuple[Column, bool, bool]:
    """The expression of a sort order, whether it descends, and whether NULLs come first."""
    from pyspark import SparkContext
    from pyspark.sql.classic.column import Column as Classic

    node = c._jc.node()
    if node.getClass().getSimpleName() != "SortOrder":
        return c, False, True
    down, first = (str(x.toString()).split("$")[-2] for x in (node.sortDirection(), node.nullOrdering()))
    return Classic(SparkContext._active_spark_context._jvm.org.apache.spark.sql.Column(node.child())), down == "Descending", first == "NullsFirst"


def _comparable(value: Column, kind: T.DataType) -> tuple[Column, str] | None:
    """An expression of the same order that JSON holds exactly, and its type."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return value.cast("bigint"), "bigint"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return value.cast("double"), "double"
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value), "bigint"
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("bigint"), "bigint"
    if isinstance(kind, (T.StringType, T.TimestampNTZType)):
        return value.cast("string"), "string"
    if isinstance(kind, T.DecimalType):
        return value, kind.simpleString()
    return (F.hex(value), "string") if isinstance(kind, T.BinaryType) else None


class Ordered:
    """Rows of an order in blocks 0, 1, 2 and so on: those of a block come before those of the next.

    The bounds of blocks come from a sample that is drawn once and are constants of the plan from there on, so a row has the
    same block in every plan, at every retry. Windows run within blocks, in parallel; what the blocks before give is one
    narrow row a block, joined as a broadcast (there is nothing to join if one block holds all). So a table is read for its count, for the sample (order columns alone), for
    what blocks give (the columns at hand alone), and once with all columns for the result, which is shuffled once. Nothing
    is written. df must give the same rows each time it is read. Rows that tie in the whole order are in one block.
    """

    def __init__(self, df: DataFrame, order_by: list[Column]):
        self.order = order_by
        self.total = df.count()
        blocks = min(MOST_BLOCKS, -(-self.total // BLOCK_ROWS))
        self.rows, self.alone = (df.withColumn(BLOCK, F.lit(0)), True) if blocks < 2 else (self._dealt(df, blocks), False)

    def _dealt(self, df: DataFrame, blocks: int) -> DataFrame:
        parts = [_order_parts(c) for c in self.order]
        kinds = [f.dataType for f in df.select(*(c.alias(str(i)) for i, (c, _, _) in enumerate(parts))).schema]
        keys = []
        for (c, down, first), kind in zip(parts, kinds, strict=True):
            made = _comparable(c, kind)
            if made is None:  # the columns before it make the blocks
                break
            keys.append((*made, down, first))
        if not keys:
            return df.withColumn(BLOCK, F.lit(0))
        names = [f"k{i}" for i in range(len(keys))]
        share = min(1.0, SAMPLED * blocks / self.total)
        rows = df.select(*(k[0].alias(n) for n, k in zip(names, keys, strict=True))).sample(share, seed=7).collect()
        for i, (_, _, down, first) in reversed(list(enumerate(keys))):
            rows.sort(key=lambda r, i=i: (r[i] != r[i], 0 if r[i] is None else r[i]) if isinstance(r[i], float) else (False, r[i]) if r[i] is not None else (False,), reverse=down)
            rows.sort(key=lambda r, i=i, first=first: (r[i] is None) != first)
        bounds = [tuple(rows[i * len(rows) // blocks]) for i in range(1, blocks)] if rows else []
        bounds = [b for i, b in enumerate(bounds) if not i or b != bounds[i - 1]]
        told = json.dumps([dict(zip(names, b, strict=True)) for b in bounds], default=str)
        table = F.from_json(F.lit(told), f"array<struct<{','.join(f'{n}:{k[1]}' for n, k in zip(names, keys, strict=True))}>>")
        # A binary search in one expression: a column made by a projection a step would be put into itself at every step where
        # Spark traces a join's keys down the plan, which grows as a power of the steps. The bounds stand in it once.
        made = [(F.col(f"_by_{n}"), *k[1:]) for n, k in zip(names, keys, strict=True)]

        def reached(bound: Column) -> Column:
            later = reduce(lambda later, x: F.when(x[1][0].eqNullSafe(bound[x[0]]), later).otherwise(_after(x[1][0], bound[x[0]], *x[1][2:])), reversed(list(zip(names, made, strict=True))), F.lit(True))
            return bound.isNotNull() & F.coalesce(later, F.lit(False))

        steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
        rows = df.select("*", *(k[0].alias(f"_by_{n}") for n, k in zip(names, keys, strict=True)))
        block = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: at + F.when(F.transform(F.array(F.get(table, at + step - 1)), reached)[0], step).otherwise(0)) if bounds else F.lit(0)
        return rows.withColumn(BLOCK, block).drop(*(f"_by_{n}" for n in names))

    def within(self, *ties: Column):
        """The window of a block's rows in order; ties: what decides between rows that are equal in the order."""
        return Window.partitionBy(BLOCK).orderBy(*self.order, *ties)

    def joined(self, rows: DataFrame, facts: DataFrame) -> DataFrame:
        """rows with the facts of their blocks (at most MOST_BLOCKS rows)."""
        return rows.join(F.broadcast(facts), BLOCK)

    def prefix(self, current: bool = True, **columns: tuple[str, Column]) -> DataFrame:
        """Rows with running aggregates, the current row included or not. A column is a kind (sum, count, min, max) and an expression."""
        within = self.within().rowsBetween(Window.unboundedPreceding, Window.currentRow if current else -1)
        kinds = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
        add = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
        if self.alone:
            return self.rows.select("*", *(kinds[k](e).over(within).alias(n) for n, (k, e) in columns.items()))
        per_block = self.rows.groupBy(BLOCK).agg(*(kinds[k](e).alias(n) for n, (k, e) in columns.items()))
        before = per_block.select(BLOCK, *(add[k](n).over(blocks_before()).alias(f"_before_{n}") for n, (k, _) in columns.items()))
        rows = self.joined(self.rows.select("*", *(kinds[k](e).over(within).alias(f"_own_{n}") for n, (k, e) in columns.items())), before)

        def both(name: str, kind: str) -> Column:
            own, old = F.col(f"_own_{name}"), F.col(f"_before_{name}")
            if kind in ("sum", "count"):
                return F.when(own.isNull(), old).otherwise(own + F.coalesce(old, F.lit(0).cast(rows.schema[f"_own_{name}"].dataType)))
            # Not least() and greatest(), which don't take structs.
            return F.when(own.isNull() | (old >= own if kind == "max" else old <= own), F.coalesce(old, own)).otherwise(own)

        made = rows.select("*", *(both(n, k).alias(n) for n, (k, _) in columns.items()))
        return made.drop(*(f"_own_{n}" for n in columns), *(f"_before_{n}" for n in columns))


def blocks_before():
    """The window over one row a block that holds the blocks before."""
    return Window.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)


def _directed(c: Column, down: bool, first: bool) -> Column:
    return (c.desc_nulls_first() if first else c.desc_nulls_last()) if down else (c.asc_nulls_first() if first else c.asc_nulls_last())


def _after(value: Column, bound: Column, down: bool, first: bool) -> Column:
    """Whether value comes after a bound that differs from it."""
    beyond = value < bound if down else value > bound
    return (value.isNotNull() & (bound.isNull() | beyond)) if first else (bound.isNotNull() & (value.isNull() | beyond))


def plain(df: DataFrame) -> DataFrame:
    return df.drop(BLOCK)


def _columns(order_by) -> list[Column]:
    if not order_by:
        raise ValueError("an order is needed: rows of a DataFrame have none of their own")
    return [F.col(c) if isinstance(c, str) else c for c in ([order_by] if isinstance(order_by, (str, Column)) else order_by)]


def with_row_number(df: DataFrame, order_by, name: str = "row_number") -> DataFrame:
    """Row numbers from 1 over all rows."""
    return plain(Ordered(df, _columns(order_by)).prefix(**{name: ("count", F.lit(1))}))


def sort(df: DataFrame, *order: Column) -> DataFrame:
    """A total sort by expressions; give a unique last one for a stable result."""
    return df.orderBy(*order)


def sort_asc(df: DataFrame, value: str = "value") -> DataFrame:
    return df.orderBy(F.col(value).asc())


def sort_desc(df: DataFrame, value: str = "value") -> DataFrame:
    return df.orderBy(F.col(value).desc())


def sort_by(df: DataFrame, *fields: str) -> DataFrame:
    """Ascending, missing values first."""
    return df.orderBy(*(F.col(f).asc_nulls_first() for f in fields))


def sort_by_desc(df: DataFrame, *fields: str) -> DataFrame:
    """Descending, missing values last."""
    return df.orderBy(*(F.col(f).desc_nulls_last() for f in fields))


def sort_with(df: DataFrame, keys: list[str], compare) -> DataFrame:
    """Within groups of the keys, rows sorted by a comparator of two struct Columns (as for array_sort). A group is one array."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*rest)), compare).alias("r")).select(*keys, F.posexplode("r").alias("position", "r")).select(*keys, "position", "r.*")


def top_k(df: DataFrame, k: int, by, tie=None) -> DataFrame:
    """The k largest, descending; of equal ones the earlier by tie. Each task keeps k rows."""
    order = [c.desc_nulls_last() for c in _columns(by)] + ([c.asc() for c in _columns(tie)] if tie is not None else [])
    return df.orderBy(*order).limit(max(k, 0))


def bottom_k(df: DataFrame, k: int, by, tie=None) -> DataFrame:
    order = [c.asc_nulls_first() for c in _columns(by)] + ([c.asc() for c in _columns(tie)] if tie is not None else [])
    return df.orderBy(*order).limit(max(k, 0))


def sort_count_window(df: DataFrame, size: int, order_by, *by: Column) -> DataFrame:
    """Rows in blocks of `size` in order, numbered within each block by the sort expressions: window_id, position."""
    from .windows import count_window

    return count_window(df, size, order_by).withColumn("position", F.row_number().over(Window.partitionBy("window_id").orderBy(*by)).cast("long"))


def sort_time_window(df: DataFrame, ts: str, duration: str, *by: Column) -> DataFrame:
    """The same within blocks of time."""
    w = F.window(ts, duration)
    return df.withColumn("window_start", w["start"]).withColumn("position", F.row_number().over(Window.partitionBy("window_start").orderBy(*by)).cast("long"))


def compose(*steps):
    return lambda df: reduce(DataFrame.transform, steps, df)
