"""Event-time windows, sessions and late rows on streams.

A stream's last windows stay open until the watermark passes them: for bounded replays use operators.event_time, where all
windows fire. Append mode drops late rows, update mode emits a window again with each change.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.event_time import ORIGIN
from ..plans.scratch import new_path


def _stamped(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """Watermarks need timestamps with a zone: others are read in the session's."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def tumbling_stream(df: DataFrame, ts: str, seconds: int, delay: str, keys: list[str], *aggregates: Column) -> DataFrame:
    """Aggregates by window and keys; delay: how far the watermark trails the largest time."""
    w = F.window(ts, f"{seconds} seconds", startTime=f"{-ORIGIN % seconds} seconds")
    return _stamped(df, ts, delay).groupBy(w.alias("window"), *keys).agg(*aggregates)


def sliding_stream(df: DataFrame, ts: str, seconds: int, slide: int, delay: str, keys: list[str], *aggregates: Column) -> DataFrame:
    w = F.window(ts, f"{seconds} seconds", f"{slide} seconds", f"{-ORIGIN % slide} seconds")
    return _stamped(df, ts, delay).groupBy(w.alias("window"), *keys).agg(*aggregates)


def session_stream(df: DataFrame, ts: str, timeout: int, delay: str, keys: list[str], *aggregates: Column) -> DataFrame:
    """Without keys a constant one is added, as Spark needs one."""
    df = df if keys else df.withColumn("all", F.lit(0))
    return _stamped(df, ts, delay).groupBy(*(keys or ["all"]), F.session_window(ts, f"{timeout} seconds").alias("session")).agg(*aggregates)


def run_available(df: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what its source has now and reads the result back as rows: for tests and replays."""
    spark = df.sparkSession
    if mode == "append":
        query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-checkpoint").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(df.schema).parquet(path)
    latest = {}

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{epoch}")
        latest["path"] = f"{path}/{epoch}"

    query = df.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}-checkpoint").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(latest["path"]) if latest else spark.createDataFrame([], df.schema)


def watermark_of(query: StreamingQuery) -> str | None:
    progress = query.lastProgress
    return (progress or {}).get("eventTime", {}).get("watermark")


def fan_out(df: DataFrame, checkpoint: str, *sinks: Callable[[DataFrame, int], None], trigger: dict | None = None) -> StreamingQuery:
    """Every sink gets every micro-batch whole, computed once."""

    def each(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, epoch)
        finally:
            batch.unpersist()

    return df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def split_late(df: DataFrame, ts: str, delay_seconds: int, on_time: str, late: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Rows older than the watermark of the batches before go to a table of their own. A retried batch overwrites what it wrote."""
    spark = df.sparkSession
    tops = f"{checkpoint}-tops"

    def write(batch: DataFrame, epoch: int) -> None:
        before = None
        if epoch:
            before = spark.read.schema(f"epoch bigint, top {batch.schema[ts].dataType.simpleString()}").parquet(tops).where(F.col("epoch") < epoch).agg(F.max("top")).head()[0]
        is_late = F.lit(False) if before is None else F.coalesce(F.col(ts) < F.lit(before) - F.make_dt_interval(secs=F.lit(delay_seconds)), F.lit(False))
        batch.where(~is_late).write.mode("overwrite").parquet(f"{on_time}/batch={epoch}")
        batch.where(is_late).write.mode("overwrite").parquet(f"{late}/batch={epoch}")
        batch.agg(F.max(ts).alias("top")).select(F.lit(epoch).cast("bigint").alias("epoch"), "top").write.mode("overwrite").parquet(f"{tops}/batch={epoch}")

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def scratch(df: DataFrame, label: str) -> str:
    return new_path(df.sparkSession, label)
