"""Per-key state on streams: running aggregates, windows closed by count or time, sessions of activity, group summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def running_stats_stream(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """For every row its key's count, sum, avg, min and max so far; rows of a micro-batch in the given order."""
    out = T.StructType([*df.schema.fields, T.StructField("count", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("sum", "avg", "min", "max"))])
    names = df.columns

    def step(k, frames, state: GroupState):
        import pandas as pd

        pdf = pd.concat(list(frames)).sort_values(order, kind="stable")
        n, total, low, high = state.get if state.exists else (0, 0.0, float("inf"), float("-inf"))
        v = pdf[value].astype("float64")
        pdf["count"] = n + v.notna().cumsum()
        pdf["sum"] = total + v.fillna(0).cumsum()
        pdf["avg"] = pdf["sum"] / pdf["count"]
        pdf["min"], pdf["max"] = v.cummin().clip(upper=low), v.cummax().clip(lower=high)
        state.update((int(pdf["count"].iloc[-1]), float(pdf["sum"].iloc[-1]), float(min(low, v.min())), float(max(high, v.max()))))
        yield pdf[[*names, "count", "sum", "avg", "min", "max"]]

    return df.groupBy(key).applyInPandasWithState(step, out, "n bigint, total double, low double, high double", "append", GroupStateTimeout.NoTimeout)


def windowed_stream(df: DataFrame, key: str, order: str, count: int | None = None, timeout_ms: int | None = None) -> DataFrame:
    """Every row, as it comes, with the window_id (from 0) of its key's window; rows of a micro-batch in the given order.

    A window closes at `count` rows, or where no row has come for timeout_ms. Rows are not held back, so the state of a key
    is three numbers.
    """
    out, names = T.StructType([*df.schema.fields, T.StructField("window_id", T.LongType())]), df.columns

    def step(k, frames, state: GroupState):
        import numpy as np
        import pandas as pd

        pdf = pd.concat(list(frames)).sort_values(order, kind="stable")
        window, size, last = state.get if state.exists else (0, 0, 0)
        now = state.getCurrentProcessingTimeMs()
        if timeout_ms and size and now - last > timeout_ms:
            window, size = window + 1, 0
        place = size + np.arange(len(pdf))
        pdf["window_id"] = window + (place // count if count else 0)
        window, size = (window + (size + len(pdf)) // count, (size + len(pdf)) % count) if count else (window, size + len(pdf))
        state.update((int(window), int(size), int(now)))
        yield pdf[[*names, "window_id"]]

    return df.groupBy(key).applyInPandasWithState(step, out, "window_id bigint, size bigint, last bigint", "append", GroupStateTimeout.NoTimeout)


def activity_sessions_stream(df: DataFrame, key: str, activity: str, order: str, timeout_ms: int) -> DataFrame:
    """Rows of sessions, as they come, with session_id (from 0 within the key); rows of a micro-batch in the given order.

    A row of activity opens a session or extends it to timeout_ms after its arrival, others ride along, those outside are
    dropped. Rows of one micro-batch arrive at once.
    """
    out, names = T.StructType([*df.schema.fields, T.StructField("session_id", T.LongType())]), df.columns

    def step(k, frames, state: GroupState):
        import numpy as np
        import pandas as pd

        pdf = pd.concat(list(frames)).sort_values(order, kind="stable")
        session, deadline = state.get if state.exists else (-1, -1)
        now, active = state.getCurrentProcessingTimeMs(), pdf[activity].fillna(False).astype(bool).to_numpy()
        begins = 0 if now <= deadline else int(np.argmax(active)) if active.any() else len(pdf)
        session += now > deadline and bool(active.any())
        pdf = pdf.iloc[begins:].assign(session_id=session)
        state.update((int(session), int(now + timeout_ms if active.any() else deadline)))
        if len(pdf):
            yield pdf[[*names, "session_id"]]

    return df.groupBy(key).applyInPandasWithState(step, out, "session_id bigint, deadline bigint", "append", GroupStateTimeout.NoTimeout)
