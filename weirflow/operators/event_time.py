"""Event-time windows over bounded rows: every window fires, none is left open at the end.

Windows are aligned to Monday, 1 January of year 1 (for sizes that divide a day it is the same as any midnight). Times are
rounded to the nearest second first unless standardize=False. Rows whose time is missing or doesn't parse are dropped;
on_missing="now" gives them the current time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import dtype, parse_time, standardize_time
from .ordering import Ordered, _columns, plain

#: Seconds from the alignment's origin to the Unix epoch.
ORIGIN = 62_135_596_800


def event_time(df: DataFrame, ts: str, standardize: bool = True, on_missing: str = "drop") -> tuple[DataFrame, T.DataType]:
    """df with the column _ts, and its type."""
    kind = dtype(df, ts)
    if kind is None:
        raise ValueError(f"no column {ts}: event-time windows need one")
    value = parse_time(F.col(ts), kind)
    out = kind if isinstance(kind, T.TimestampNTZType) else T.TimestampType()
    value = (standardize_time(value, out) if standardize else value).cast(out)
    if on_missing == "now":
        value = F.coalesce(value, F.current_timestamp().cast(out))
    return df.withColumn("_ts", value).where(F.col("_ts").isNotNull()), out


def _offset(seconds: int) -> str:
    return f"{-ORIGIN % seconds} seconds"


def tumbling(df: DataFrame, ts: str, seconds: int, standardize: bool = True, on_missing: str = "drop") -> DataFrame:
    """Rows with window_start and window_end."""
    rows, _ = event_time(df, ts, standardize, on_missing)
    w = F.window("_ts", f"{seconds} seconds", startTime=_offset(seconds))
    return rows.withColumn("_w", w).withColumn("window_start", F.col("_w.start")).withColumn("window_end", F.col("_w.end")).drop("_w", "_ts")


def sliding(df: DataFrame, ts: str, seconds: int, slide: int, standardize: bool = True, on_missing: str = "drop") -> DataFrame:
    """Rows once for each window they are in; with a slide longer than the size, rows in gaps are in none."""
    rows, _ = event_time(df, ts, standardize, on_missing)
    if slide > seconds:
        rows = rows.withColumn("_w", F.window("_ts", f"{slide} seconds", startTime=_offset(slide)))
        end = F.col("_w.start") + F.make_dt_interval(secs=F.lit(seconds))
        rows = rows.where(F.col("_ts") < end).withColumn("window_start", F.col("_w.start")).withColumn("window_end", end)
    else:
        rows = rows.withColumn("_w", F.window("_ts", f"{seconds} seconds", f"{slide} seconds", _offset(slide))).withColumn("window_start", F.col("_w.start")).withColumn("window_end", F.col("_w.end"))
    return rows.drop("_w", "_ts")


def session(df: DataFrame, ts: str, timeout: int, keys: list[str], *aggregates: Column, standardize: bool = True) -> DataFrame:
    """One row for each session of a key: session_start, session_end (last row's time plus timeout) and the aggregates.

    A gap longer than timeout seconds splits; an equal one doesn't.
    """
    rows, _ = event_time(df, ts, standardize)
    w = F.session_window("_ts", f"{timeout} seconds")
    out = rows.groupBy(*keys, w.alias("_w")).agg(*aggregates)
    return out.withColumn("session_start", F.col("_w.start")).withColumn("session_end", F.col("_w.end")).drop("_w")


def with_watermark(df: DataFrame, ts: str, arrival, delay_seconds: int, keys: list[str] | None = None) -> DataFrame:
    """Replay: watermark as it stands before each row in order of arrival: the largest time so far less the delay."""
    order = _columns(arrival)
    rows, kind = event_time(df, ts, standardize=False)
    if keys:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        top = rows.withColumn("_top", F.max("_ts").over(w))
    else:
        top = plain(Ordered(rows, order).prefix(current=False, _top=("max", F.col("_ts"))))
    return top.withColumn("watermark", F.col("_top") - F.make_dt_interval(secs=F.lit(delay_seconds))).drop("_top", "_ts")


def late_split(df: DataFrame, ts: str, arrival, seconds: int, delay_seconds: int, allowed_lateness: int = 0, policy: str = "drop", slide: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """Rows with their window and late: its end (plus the allowed lateness) is not after the watermark on arrival.

    Windows are tumbling, or with slide sliding, where a row can be late for some of its windows. policy: "drop" leaves late
    rows out, "side_output" keeps all with the flag, "update" keeps all as if on time. keys: a watermark for each key.
    """
    marked = with_watermark(df, ts, arrival, delay_seconds, keys)
    rows = sliding(marked, ts, seconds, slide, standardize=False) if slide else tumbling(marked, ts, seconds, standardize=False)
    return _by_policy(rows, F.col("window_end"), allowed_lateness, policy)


def late_for_sessions(df: DataFrame, ts: str, arrival, timeout: int, delay_seconds: int, allowed_lateness: int = 0, policy: str = "drop", keys: list[str] | None = None) -> DataFrame:
    """Rows with late: a session of their time alone would have ended (plus the allowed lateness) by the watermark on arrival.

    What is left goes to session(). Policies are those of late_split().
    """
    rows, _ = event_time(with_watermark(df, ts, arrival, delay_seconds, keys), ts, standardize=False)
    return _by_policy(rows, F.col("_ts") + F.make_dt_interval(secs=F.lit(timeout)), allowed_lateness, policy).drop("_ts")


def _by_policy(rows: DataFrame, end: Column, allowed_lateness: int, policy: str) -> DataFrame:
    late = F.coalesce(end + F.make_dt_interval(secs=F.lit(allowed_lateness)) <= F.col("watermark"), F.lit(False))
    rows = rows.withColumn("late", late)
    if policy == "drop":
        return rows.where(~F.col("late")).drop("late")
    return rows.drop("late") if policy == "update" else rows
