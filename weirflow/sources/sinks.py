"""Writers and actions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"}


def _chosen(df: DataFrame, headers: list[str] | None) -> DataFrame:
    """The headers in order; those that df lacks are empty, other columns are left out."""
    names = headers or df.columns
    flat = [F.col(f"`{h}`") if h in df.columns else F.lit(None).cast("string").alias(h) for h in names]
    return df.select(*(F.to_json(c).alias(h) if h in df.columns and isinstance(df.schema[h].dataType, (T.StructType, T.ArrayType, T.MapType)) else c for c, h in zip(flat, names, strict=True)))


def write_csv(df: DataFrame, path: str, headers: list[str] | None = None, sep: str = ",", mode: str = "error") -> None:
    """Values are quoted where needed; NULL is an empty cell; nested values are JSON text."""
    _chosen(df, headers).write.mode(mode).options(header=True, sep=sep, quote='"', escape='"', nullValue="", emptyValue="", **_TIMES).csv(path)


def write_tsv(df: DataFrame, path: str, headers: list[str] | None = None, mode: str = "error") -> None:
    write_csv(df, path, headers, "\t", mode)


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    """Lines of objects; numbers stay numbers, NULL fields are left out."""
    df.write.mode(mode).options(**_TIMES).json(path)


def write_json_array(df: DataFrame, path: str, order_by, pretty: bool = False, mode: str = "error") -> None:
    """All rows as one array in one file: gathered in one task, so for results that fit there. pretty: indented."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order_by).alias("o"), F.struct(*df.columns).alias("v")))), lambda x: x["v"])
    df.agg(F.to_json(rows, {"pretty": str(pretty).lower(), **_TIMES}).alias("value")).coalesce(1).write.mode(mode).text(path)


def write_partitioned(df: DataFrame, path: str, *keys: str, mode: str = "error") -> None:
    df.repartition(*keys).write.mode(mode).partitionBy(*keys).parquet(path)


def stream_to_csv(df: DataFrame, path: str, checkpoint: str, sep: str = ",", trigger: dict | None = None) -> StreamingQuery:
    """Appends each micro-batch as files; rows of a batch are written once, whatever is retried."""
    return df.writeStream.format("csv").options(header=True, sep=sep, path=path, checkpointLocation=checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def collect(df: DataFrame) -> list:
    return df.collect()


def for_each(df: DataFrame, fn) -> None:
    """fn for every row, on the executors."""
    df.foreach(fn)


def for_each_local(df: DataFrame, fn) -> None:
    """fn for every row, on the driver, one partition in memory at a time."""
    for row in df.toLocalIterator():
        fn(row)
