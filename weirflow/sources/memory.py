"""Rows from Python values, ranges and generators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, SimpleDataSourceStreamReader


def from_values(spark: SparkSession, values: Iterable, to: str = "bigint", checked: bool = True) -> DataFrame:
    """A column `value`; checked=False infers the type from the values."""
    rows = [(v,) for v in values]
    return spark.createDataFrame(rows, f"value {to}" if checked else ["value"])


def once(spark: SparkSession, value, to: str = "bigint") -> DataFrame:
    return from_values(spark, [value], to)


def from_records(spark: SparkSession, records: Iterable[dict | Row], schema: str | T.StructType | None = None, checked: bool = True) -> DataFrame:
    """Rows from dicts; missing fields are NULL. checked: values must be of the schema's types, and the error names the field."""
    rows = [r.asDict() if isinstance(r, Row) else dict(r) for r in records]
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if schema is None:
        return spark.createDataFrame([Row(**r) for r in rows]) if rows else spark.createDataFrame([], "empty string")
    return spark.createDataFrame([tuple(r.get(f) for f in schema.fieldNames()) for r in rows], schema, verifySchema=checked)


class RecordBuilder:
    """A record field by field, each of a given type; fields keep their order. An unset or None value is NULL.

    A value that isn't of its type is refused when it is set, with the field's name.
    """

    def __init__(self):
        self._fields: dict[str, tuple[T.DataType, object]] = {}

    def field(self, name: str, value, to: str) -> RecordBuilder:
        kind = T._parse_datatype_string(to)
        T._make_type_verifier(kind, nullable=True, name=f"field {name}")(value)
        self._fields[name] = kind, value
        return self

    def int(self, name: str, value: int | None) -> RecordBuilder:
        return self.field(name, value, "bigint")

    def float(self, name: str, value: float | None) -> RecordBuilder:
        return self.field(name, value, "double")

    def string(self, name: str, value: str | None) -> RecordBuilder:
        return self.field(name, value, "string")

    def bool(self, name: str, value: bool | None) -> RecordBuilder:
        return self.field(name, value, "boolean")

    def time(self, name: str, value) -> RecordBuilder:
        return self.field(name, value, "timestamp")

    def array(self, name: str, value: list | None, of: str) -> RecordBuilder:
        return self.field(name, value, f"array<{of}>")

    def record(self, name: str, value: RecordBuilder) -> RecordBuilder:
        self._fields[name] = value.schema, value.values
        return self

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, kind) for n, (kind, _) in self._fields.items()])

    @property
    def values(self) -> tuple:
        return tuple(v for _, v in self._fields.values())


def from_built(spark: SparkSession, *records: RecordBuilder) -> DataFrame:
    """Rows of built records. Their schemas are merged by name; a field that a record lacks is NULL, types must agree."""
    fields: dict[str, T.DataType] = {}
    for r in records:
        for f in r.schema:
            if fields.setdefault(f.name, f.dataType) != f.dataType:
                raise TypeError(f"field {f.name} is {fields[f.name].simpleString()} and {f.dataType.simpleString()}")
    schema = T.StructType([T.StructField(n, kind) for n, kind in fields.items()])
    rows = [tuple(dict(zip(r.schema.fieldNames(), r.values, strict=True)).get(n) for n in fields) for r in records]
    return spark.createDataFrame(rows, schema) if fields else spark.createDataFrame([], "empty string")


def value_range(spark: SparkSession, start: int, end: int, step: int = 1) -> DataFrame:
    """start, start + step, ... before end, as a column `value`; a step of 0 would not end and is refused."""
    if step == 0:
        raise ValueError("step must not be 0")
    return spark.range(start, end, step).withColumnRenamed("id", "value")


class _Generated(DataSourceReader):
    def __init__(self, make: Callable[[], Iterable[tuple]]):
        self.make = make

    def read(self, partition) -> Iterator[tuple]:
        yield from self.make()


class _GeneratedStream(SimpleDataSourceStreamReader):
    """Offsets count values: a batch is the next `size` values of make(first number, how many)."""

    def __init__(self, make: Callable[[int, int], Iterable[tuple]], size: int):
        self.make, self.size = make, size

    def initialOffset(self) -> dict:
        return {"n": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = list(self.make(start["n"], self.size))
        return iter(rows), {"n": start["n"] + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(list(self.make(start["n"], end["n"] - start["n"])))


def generate(spark: SparkSession, make: Callable[[], Iterable[tuple]], schema: str) -> DataFrame:
    """Rows of a generator that ends by itself, made where they are read (one task)."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return "weirflow_generate"

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return _Generated(make)

    spark.dataSource.register(Source)
    return spark.read.format("weirflow_generate").load()


def generate_stream(spark: SparkSession, make: Callable[[int, int], Iterable[tuple]], schema: str, size: int = 1000) -> DataFrame:
    """An unbounded stream of what make(first number, how many) gives; it must give the same rows when asked again."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return "weirflow_generate_stream"

        def schema(self) -> str:
            return schema

        def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
            return _GeneratedStream(make, size)

    spark.dataSource.register(Source)
    return spark.readStream.format("weirflow_generate_stream").load()


def folder_stream(spark: SparkSession, path: str, schema: str, file_format: str = "json", files_per_batch: int | None = None) -> DataFrame:
    """A channel between processes: files dropped into a folder are rows of a stream, each read once."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).format(file_format).load(path)
