"""CSV, TSV and JSON files as typed rows.

Cells are typed by what all cells of a column look like (functions.coerce.infer_cells) unless types are given, which saves
a pass over the files. Blank lines of JSON are skipped; malformed rows are an error.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coerce import typed_cells


def read_csv(spark: SparkSession, path, header: bool = True, headers: list[str] | None = None, types: dict[str, str] | None = None, sep: str = ",", typed: bool = True, multi_line: bool | None = None) -> DataFrame:
    """Quoted cells as in RFC 4180. Files are split among tasks unless a cell holds a line break, when a file is one task's.

    multi_line=None looks for such cells in a pass over the lines: a record that goes on in the next line has an odd number
    of quotes in its first. False saves the pass. Without a header row columns are col0, col1, ...; headers renames the first ones, the rest are extra_col{i}.

    An empty file gives no rows (and no columns without headers).
    """
    if multi_line is None:
        multi_line = bool(spark.read.text(path).where("(length(value) - length(replace(value, '\"'))) % 2 = 1").limit(1).count())
    raw = spark.read.options(header=header, sep=sep, quote='"', escape='"', multiLine=multi_line, mode="FAILFAST", emptyValue="", nullValue="\0").csv(path)
    if not raw.columns:
        return spark.createDataFrame([], ", ".join(f"`{h}` string" for h in headers) if headers else "col0 string")
    n = len(raw.columns)
    if headers:
        raw = raw.toDF(*(headers[i] if i < len(headers) else f"extra_col{i}" for i in range(n)))
    elif not header:
        raw = raw.toDF(*(f"col{i}" for i in range(n)))
    return typed_cells(raw, types) if typed else raw


def read_tsv(spark: SparkSession, path, **options) -> DataFrame:
    return read_csv(spark, path, sep="\t", **options)


def read_delimited(spark: SparkSession, path, sep: str = "\t", header: bool = True, headers: list[str] | None = None, types: dict[str, str] | None = None, typed: bool = True) -> DataFrame:
    """Lines split at a separator of any length, without quoting. Blank lines are skipped; the header is each file's first line.

    Cells beyond the headers are dropped, missing ones are NULL. Without a header row columns are field_0, field_1, ...
    """
    # As one column of a CSV file without quotes, so that the reader drops each file's first line, wherever files are cut.
    lines = spark.read.options(header=header, sep="\uffff", quote="", maxCharsPerColumn=-1).csv(path)
    if not lines.columns:
        return spark.createDataFrame([], ", ".join(f"`{h}` string" for h in headers) if headers else "field_0 string")
    first = lines.columns[0]
    lines, parts = lines.toDF("value"), F.split("value", re.escape(sep))
    if header:
        names = headers or [x.strip() for x in first.split(sep)]
    else:
        names = headers or [f"field_{i}" for i in range(lines.agg(F.max(F.size(parts))).head()[0] or 0)]
    rows = lines.where(F.trim("value") != "")
    raw = rows.select(*(F.trim(F.try_element_at(parts, F.lit(i + 1))).alias(n) for i, n in enumerate(names)))
    return typed_cells(raw, types) if typed and names else raw


def read_json(spark: SparkSession, path, schema: str | None = None, array: bool = False) -> DataFrame:
    """Lines of objects, or (array=True) one array of objects a file."""
    reader = spark.read.option("mode", "FAILFAST").option("multiLine", array)
    return (reader.schema(schema) if schema else reader).json(path)


def stream_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = True) -> DataFrame:
    return spark.readStream.schema(schema).options(header=header, sep=sep).csv(path)


def stream_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
