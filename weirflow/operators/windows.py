"""Windows by count, trigger and arrival time, as a window_id column over rows in a given order.

Global windows are computed over blocks of the order (see ordering.Ordered), so no task sees all rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import BLOCK, Ordered, _columns, blocks_before, plain


def _numbered(df: DataFrame, order_by, keys: list[str] | None) -> tuple[DataFrame, Column]:
    """Rows with their number _rn from 1 (within keys, if given), and how many there are."""
    if keys:
        rows = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*_columns(order_by))).cast("long"))
        return rows, F.count(F.lit(1)).over(Window.partitionBy(*keys))
    o = Ordered(df, _columns(order_by))
    return plain(o.prefix(_rn=("count", F.lit(1)))), F.lit(o.total)


def count_window(df: DataFrame, size: int, order_by, keys: list[str] | None = None) -> DataFrame:
    """Consecutive blocks of `size` rows, the last one as it is; window_id from 0 (within keys, if given)."""
    if size <= 0:
        raise ValueError("size must be positive")
    return _numbered(df, order_by, keys)[0].withColumn("window_id", F.floor((F.col("_rn") - 1) / size)).drop("_rn")


def sliding_count_window(df: DataFrame, size: int, step: int, order_by, keys: list[str] | None = None) -> DataFrame:
    """Full windows of `size` rows, a new one every `step` rows. A row is repeated for each of its windows.

    Which windows are full is known from the number of rows, so nothing is counted per window.
    """
    if size <= 0 or not 0 < step <= size:
        raise ValueError("size must be positive and step within 1 .. size")
    rows, every = _numbered(df, order_by, keys)
    rows = rows.withColumn("_all", every)
    first = F.greatest(F.lit(0), F.ceil((F.col("_rn") - size) / step)).cast("long")
    last = F.least(F.floor((F.col("_rn") - 1) / step), F.floor((F.col("_all") - size) / step)).cast("long")
    return rows.where((F.col("_all") >= size) & (first <= last)).withColumn("window_id", F.explode(F.sequence(first, last))).drop("_rn", "_all")


@dataclass(frozen=True)
class CountTrigger:
    """Fires on every n-th row."""

    n: int



@dataclass(frozen=True)
class ValueChangeTrigger:
    """Fires on the first row and where the field differs from the row before."""

    field: str

    def fire(self) -> Column:
        return F.col("_lag").isNull() | ~F.col("_lag.v").eqNullSafe(F.col(self.field))


@dataclass(frozen=True)
class ConditionTrigger:
    """Fires where a condition holds."""

    condition: Column

    def fire(self) -> Column:
        return F.coalesce(self.condition, F.lit(False))


def triggered_window(df: DataFrame, trigger, order_by, keys: list[str] | None = None) -> DataFrame:
    """The row on which the trigger fires closes its window; the rows after the last firing are a window too.

    Without keys, what the blocks of the order before a row give is a number of firings, found in one pass over the columns
    that the trigger needs. Of a change of value a block also gives its first and last values, as its first row fires by
    the last one of the block before.
    """
    if isinstance(trigger, CountTrigger):
        return count_window(df, trigger.n, order_by, keys)
    changes = isinstance(trigger, ValueChangeTrigger)
    value = F.struct((F.col(trigger.field) if changes else F.lit(0)).alias("v"))
    if keys:
        w = Window.partitionBy(*keys).orderBy(*_columns(order_by))
        rows = df.withColumn("_lag", F.lag(value).over(w)).withColumn("_fire", trigger.fire().cast("long"))
        return rows.withColumn("window_id", F.coalesce(F.sum("_fire").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_lag", "_fire")
    o = Ordered(df, _columns(order_by))
    if not changes:
        rows = o.prefix(current=False, window_id=("sum", trigger.fire().cast("long")))
        return plain(rows.withColumn("window_id", F.coalesce("window_id", F.lit(0))))
    if o.alone:
        return plain(triggered_window(o.rows, trigger, order_by, [BLOCK]))
    # Rows that tie in the order are told apart by the value, so that both passes see one order.
    w = o.within(F.col(trigger.field))
    rows = o.rows.withColumn("_lag", F.lag(value).over(w)).withColumn("_end", F.lead(F.lit(True)).over(w).isNull())
    change = F.col("_lag").isNotNull() & trigger.fire()
    ends = rows.groupBy(BLOCK).agg(F.count_if(change).alias("n"), F.max(F.when(F.col("_lag").isNull(), value)).alias("first"), F.max(F.when(F.col("_end"), value)).alias("last"))
    ends = ends.withColumn("_before", F.last("last").over(blocks_before())).withColumn("_opens", F.col("_before").isNull() | ~F.col("_before.v").eqNullSafe(F.col("first.v")))
    ends = ends.select(BLOCK, "_opens", F.coalesce(F.sum(F.col("n") + F.col("_opens").cast("long")).over(blocks_before()), F.lit(0)).alias("_fired"))
    rows = o.joined(rows.drop("_end"), ends).withColumn("_fire", F.when(F.col("_lag").isNull(), F.col("_opens")).otherwise(trigger.fire()).cast("long"))
    closed = F.coalesce(F.sum("_fire").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return plain(rows.withColumn("window_id", F.col("_fired") + closed)).drop("_lag", "_opens", "_fired", "_fire")


def time_window(df: DataFrame, arrival: str, duration: str) -> DataFrame:
    """Blocks of arrival time; for streams, stamp rows with current_timestamp() on arrival."""
    w = F.window(arrival, duration)
    return df.withColumn("window_start", w["start"]).withColumn("window_end", w["end"])


@dataclass
class _Open:
    """The window of a key that is open: its number, rows since the count began, microseconds of its start and of the last firing."""

    window: int = 0
    n: int = 0
    start: int | None = None
    fired: int | None = None


@dataclass(frozen=True)
class WindowBuilder:
    """Windows closed by the first of several triggers; all triggers start anew when one fires (carry=True: only that one).

    on_count(n): so many rows since the start. on_time(s): the arrival is s seconds or more after the window's first one.
    on_processing_time(s): s seconds or more since the last firing (or the first row). on(column): a boolean column.
    Without triggers everything is one window. allow_lateness(s): rows whose event time is more than s seconds behind the
    largest one that has arrived before are left out; apply() then needs the column of event times. Rows without an arrival
    are left out.

    Time triggers depend on where the window before has ended, one window after another. So rows of one key pass one task,
    sorted, as a stream of batches that holds no more than a batch; a batch costs a few lookups a window. Give keys for more
    tasks.
    """

    count: int | None = None
    seconds: float | None = None
    interval: float | None = None
    condition: str | None = None
    carry: bool = False
    lateness: float | None = None
    accumulation: str = "discarding"
    keys: tuple[str, ...] = field(default=())

    def _with(self, **more) -> WindowBuilder:
        return replace(self, **more)

    def on_count(self, n: int) -> WindowBuilder:
        return self._with(count=n)

    def on_time(self, seconds: float) -> WindowBuilder:
        return self._with(seconds=seconds)

    def on_processing_time(self, seconds: float) -> WindowBuilder:
        return self._with(interval=seconds)

    def on(self, column: str) -> WindowBuilder:
        return self._with(condition=column)

    def allow_lateness(self, seconds: float) -> WindowBuilder:
        return self._with(lateness=seconds)

    def accumulating(self) -> WindowBuilder:
        """Each window also holds the rows of those before it (within its key)."""
        return self._with(accumulation="accumulating")

    def discarding(self) -> WindowBuilder:
        return self._with(accumulation="discarding")

    def _advance(self, t, hit, at: _Open):
        """Window numbers of a key's next rows: t in microseconds, ascending; hit: where the condition holds."""
        import numpy as np

        ids, i, m, span = np.empty(len(t), dtype=np.int64), 0, len(t), lambda s: round(s * 1e6)
        while i < m:
            at.start = int(t[i]) if at.start is None else at.start
            at.fired = int(t[i]) if at.fired is None else at.fired
            due = [m]
            if self.count is not None:
                due.append(i + max(self.count - at.n, 1) - 1)
            if self.seconds is not None:
                due.append(max(i, int(np.searchsorted(t, at.start + span(self.seconds)))))
            if self.interval is not None:
                due.append(max(i, int(np.searchsorted(t, at.fired + span(self.interval)))))
            k = int(np.searchsorted(hit, i))
            if k < len(hit):
                due.append(int(hit[k]))
            j = min(due)
            ids[i : j + 1] = at.window
            at.n += min(j + 1, m) - i
            if j >= m:
                break
            now = int(t[j])
            by_time = self.seconds is not None and now - at.start >= span(self.seconds)
            by_interval = self.interval is not None and now - at.fired >= span(self.interval)
            at.n = 0 if not self.carry or self.count is not None and at.n >= self.count else at.n
            at.start = None if not self.carry or by_time else at.start
            at.fired = now if not self.carry or by_interval else at.fired
            at.window += 1
            i = j + 1
        return ids

    def apply(self, df: DataFrame, arrival: str, tie: str, event_time: str | None = None) -> DataFrame:
        """df with window_id, over rows by arrival and tie."""
        names = df.columns
        if self.lateness is not None:
            if event_time is None:
                raise ValueError("lateness needs the column of event times")
            from .event_time import with_watermark

            marked = with_watermark(df, event_time, [arrival, tie], self.lateness, list(self.keys))
            df = marked.where(F.col("watermark").isNull() | (F.col(event_time) >= F.col("watermark"))).select(*names)
        if self.seconds is None and self.interval is None and self.condition is None:
            out = count_window(df, self.count, [arrival, tie], list(self.keys)) if self.count else df.withColumn("window_id", F.lit(0).cast("long"))
        else:
            out = self._scanned(df, arrival, tie)
        if self.accumulation == "discarding":
            return out
        last = out.groupBy(*self.keys).agg(F.max("window_id").alias("_last")) if self.keys else out.agg(F.max("window_id").alias("_last"))
        joined = out.join(last, list(self.keys)) if self.keys else out.crossJoin(F.broadcast(last))
        return joined.withColumn("window_id", F.explode(F.sequence("window_id", "_last"))).drop("_last")

    def _scanned(self, df: DataFrame, arrival: str, tie: str) -> DataFrame:
        rows = df.where(F.col(arrival).isNotNull())
        rows = rows.repartition(*self.keys) if self.keys else rows.repartition(1)
        rows = rows.sortWithinPartitions(*self.keys, arrival, tie)
        keyed = rows.select("*", F.unix_micros(F.col(arrival).cast("timestamp")).alias("_us"), F.coalesce(F.col(self.condition), F.lit(False)).alias("_hit") if self.condition else F.lit(False).alias("_hit"), F.struct(*(self.keys or [F.lit(0)])).alias("_key"))
        schema, n = df.withColumn("window_id", F.lit(0).cast("long")).schema, len(df.columns)

        def scan(batches):
            import numpy as np
            import pyarrow as pa

            here, at = None, _Open()
            for batch in batches:
                if not batch.num_rows:
                    continue
                t, hits = (np.asarray(batch.column(i)) if i == n else batch.column(i).to_numpy(zero_copy_only=False) for i in (n, n + 1))
                keys = batch.column(n + 2).to_pylist()
                cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)] if self.keys else [0, len(keys)]
                ids = []
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if self.keys and (here is None or keys[a] != here):
                        here, at = keys[a], _Open()
                    ids.append(self._advance(t[a:b], np.flatnonzero(hits[a:b]), at))
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(np.concatenate(ids))], schema.names)

        return keyed.mapInArrow(scan, schema)


def session_window(df: DataFrame, arrival: str, tie: str, timeout_seconds: float, is_activity: Column, keys: list[str] | None = None) -> DataFrame:
    """Sessions by arrival: an activity opens one or extends it to timeout after it; other rows ride along; those outside are dropped.

    Rows get session_id (from 0 within the keys). Without keys the last activity before each row and the session numbers are
    prefixes over blocks of the order.
    """
    seconds = F.unix_micros(F.col(arrival).cast("timestamp")) / 1e6
    act = F.when(F.coalesce(is_activity, F.lit(False)), seconds)
    if keys:
        w = Window.partitionBy(*keys).orderBy(arrival, tie)
        rows = df.withColumn("_at", seconds).withColumn("_act", act)
        rows = rows.withColumn("_last", F.max("_act").over(w.rowsBetween(Window.unboundedPreceding, -1)))
        rows = rows.withColumn("_new", (F.col("_act").isNotNull() & (F.col("_last").isNull() | (F.col("_at") - F.col("_last") > timeout_seconds))).cast("long"))
        rows = rows.withColumn("_n", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        inside = F.col("_act").isNotNull() | (F.col("_at") - F.col("_last") <= timeout_seconds)
        return rows.where(inside).withColumn("session_id", F.col("_n") - 1).drop("_at", "_act", "_last", "_new", "_n")
    o = Ordered(df.withColumn("_at", seconds).withColumn("_act", act), _columns([arrival, tie]))
    if o.alone:
        return plain(session_window(o.rows.drop("_at", "_act"), arrival, tie, timeout_seconds, is_activity, [BLOCK]))
    gap = lambda at, last: F.coalesce(at - last > timeout_seconds, F.lit(False))
    w = o.within().rowsBetween(Window.unboundedPreceding, -1)
    rows = o.rows.withColumn("_own", F.max("_act").over(w))
    # A block gives its first and last activity and the sessions that open after its first one.
    ends = rows.groupBy(BLOCK).agg(F.min("_act").alias("first"), F.max("_act").alias("last"), F.count_if(F.col("_act").isNotNull() & gap(F.col("_act"), F.col("_own"))).alias("n"))
    ends = ends.withColumn("_old", F.max("last").over(blocks_before())).withColumn("opens", F.col("first").isNotNull() & (F.col("_old").isNull() | gap(F.col("first"), F.col("_old"))))
    ends = ends.select(BLOCK, "_old", F.coalesce(F.sum(F.col("n") + F.col("opens").cast("long")).over(blocks_before()), F.lit(0)).alias("_opened"))
    rows = o.joined(rows, ends).withColumn("_last", F.coalesce("_own", "_old"))
    rows = rows.withColumn("_new", (F.col("_act").isNotNull() & (F.col("_last").isNull() | gap(F.col("_at"), F.col("_last")))).cast("long"))
    rows = plain(rows.withColumn("_n", F.col("_opened") + F.sum("_new").over(o.within().rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    inside = F.col("_act").isNotNull() | (F.col("_at") - F.col("_last") <= timeout_seconds)
    return rows.where(inside).withColumn("session_id", F.col("_n") - 1).drop("_at", "_act", "_own", "_old", "_opened", "_last", "_new", "_n")


WindowFilter = Callable[[DataFrame], DataFrame]
