"""Protocol buffer files: length-delimited messages or JSON lines, by a descriptor set.

Messages become structs: repeated fields arrays, maps maps with text keys, enums their names, bytes binary, unsigned 64-bit
numbers decimals; a field that isn't set is NULL. Files are read through Spark (any store), one file a task at most.
Writing makes one file for each partition in a folder of a file system that all executors share.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def message_class(descriptors: bytes, name: str):
    """The class of a message type of a serialized FileDescriptorSet."""
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

    pool = descriptor_pool.DescriptorPool()
    for f in descriptor_pb2.FileDescriptorSet.FromString(descriptors).file:
        pool.Add(f)
    return message_factory.GetMessageClass(pool.FindMessageTypeByName(name))


def _repeated(f) -> bool:
    return f.is_repeated if hasattr(f, "is_repeated") else f.label == f.LABEL_REPEATED


def _kind(f, many: bool = True) -> T.DataType:
    if many and _repeated(f):
        if f.message_type is not None and f.message_type.GetOptions().map_entry:
            return T.MapType(T.StringType(), _kind(f.message_type.fields_by_name["value"]))
        return T.ArrayType(_kind(f, False))
    if f.message_type is not None:
        return struct_type(f.message_type)
    numbers = {f.CPPTYPE_INT32: T.LongType(), f.CPPTYPE_INT64: T.LongType(), f.CPPTYPE_UINT32: T.LongType(), f.CPPTYPE_UINT64: T.DecimalType(20, 0), f.CPPTYPE_DOUBLE: T.DoubleType(), f.CPPTYPE_FLOAT: T.FloatType(), f.CPPTYPE_BOOL: T.BooleanType(), f.CPPTYPE_ENUM: T.StringType()}
    return numbers.get(f.cpp_type) or (T.BinaryType() if f.type == f.TYPE_BYTES else T.StringType())


def struct_type(descriptor) -> T.StructType:
    return T.StructType([T.StructField(f.name, _kind(f)) for f in descriptor.fields])


def to_python(message) -> dict:
    """A message's set fields, as values of struct_type()."""
    from decimal import Decimal

    def one(f, v):
        if f.message_type is not None:
            return to_python(v)
        if f.cpp_type == f.CPPTYPE_ENUM:
            named = f.enum_type.values_by_number.get(v)
            return named.name if named else str(v)
        return Decimal(v) if f.cpp_type == f.CPPTYPE_UINT64 else v

    out = {}
    for f, v in message.ListFields():
        if _repeated(f) and f.message_type is not None and f.message_type.GetOptions().map_entry:
            inner = f.message_type.fields_by_name["value"]
            out[f.name] = {str(k).lower() if isinstance(k, bool) else str(k): one(inner, x) for k, x in v.items()}
        else:
            out[f.name] = [one(f, x) for x in v] if _repeated(f) else one(f, v)
    return out


def from_python(message, values: dict):
    """Sets the message's fields; unknown names and NULLs are skipped, a value of the wrong type is an error."""
    for f in message.DESCRIPTOR.fields:
        v = values.get(f.name)
        if v is None:
            continue
        v = v.asDict() if hasattr(v, "asDict") else v
        if _repeated(f) and f.message_type is not None and f.message_type.GetOptions().map_entry:
            key, inner = f.message_type.fields_by_name["key"], f.message_type.fields_by_name["value"]
            for k, x in v.items():
                k = (k == "true") if key.cpp_type == f.CPPTYPE_BOOL else k if key.cpp_type == f.CPPTYPE_STRING else int(k)
                if inner.message_type is not None:
                    from_python(getattr(message, f.name)[k], x.asDict() if hasattr(x, "asDict") else x)
                else:
                    getattr(message, f.name)[k] = _scalar(inner, x)
        elif f.message_type is not None:
            for x in v if _repeated(f) else [v]:
                target = getattr(message, f.name)
                from_python(target.add() if _repeated(f) else target, x.asDict() if hasattr(x, "asDict") else x)
                if not _repeated(f):
                    target.SetInParent()
        elif _repeated(f):
            getattr(message, f.name).extend(_scalar(f, x) for x in v)
        else:
            setattr(message, f.name, _scalar(f, v))
    return message


def _scalar(f, v):
    if f.cpp_type == f.CPPTYPE_ENUM:
        return f.enum_type.values_by_name[v].number if isinstance(v, str) else v
    if f.cpp_type == f.CPPTYPE_UINT64:
        return int(v)
    return bytes(v) if f.type == f.TYPE_BYTES else v


def _varint(data: bytes, at: int) -> tuple[int | None, int]:
    shift = value = 0
    while at < len(data):
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7
        if shift > 63:
            raise ValueError("a length of more than 64 bits")
    return None, at


def messages(data: bytes | BinaryIO, cls, chunk: int = 1 << 20) -> Iterator:
    """Length-delimited messages of bytes or of an open file, which is read in chunks; an end within a length is the end, within a message an error."""
    source = io.BytesIO(data) if isinstance(data, bytes) else data
    buffer, at = b"", 0
    while True:
        size, after = _varint(buffer, at)
        if size is None or after + size > len(buffer):
            more = source.read(max(chunk, 0 if size is None else after + size - len(buffer)))
            if more:
                buffer, at = buffer[at:] + more, 0
                continue
            if size is None:
                return
            raise ValueError(f"a message of {size} bytes is cut off after {len(buffer) - after}")
        yield cls.FromString(buffer[after : after + size])
        at = after + size


def delimited(message) -> bytes:
    body = message.SerializeToString()
    n, head = len(body), bytearray()
    while n > 0x7F:
        head.append(n & 0x7F | 0x80)
        n >>= 7
    head.append(n)
    return bytes(head) + body


#: Schemes that pyarrow opens where the executors run.
_STREAMED = ("file", "hdfs", "s3", "s3a", "gs")


def _file_system(uri: str):
    """The pyarrow file system of a path or URI, and the path in it."""
    from pyarrow import fs

    scheme = uri.split(":", 1)[0] if ":/" in uri else ""
    if scheme in ("", "file"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/") if scheme else uri
    return fs.FileSystem.from_uri(re.sub("^s3a:", "s3:", quote(uri, safe=":/")))


def read_protobuf(spark: SparkSession, path: str, descriptors: bytes, message: str, json_lines: bool = False) -> DataFrame:
    """Rows of length-delimited messages (a file is one task's, read as a stream, whatever its size) or of lines of JSON.

    On file systems that only Spark opens a binary file is one value, so at most 2 GB.
    """
    schema = struct_type(message_class(descriptors, message).DESCRIPTOR)
    if json_lines:
        files, streamed = spark.read.text(path), False
    else:
        found = spark.read.format("binaryFile").load(path)
        first = found.select("path").limit(1).collect()
        streamed = bool(first) and first[0].path.split(":", 1)[0] in _STREAMED
        files = found.select("path" if streamed else "content")

    def parse(batches):
        import pyarrow as pa
        from google.protobuf import json_format
        from pyspark.sql.pandas.types import to_arrow_schema

        cls, target = message_class(descriptors, message), to_arrow_schema(schema)

        def of_file(value):
            if not streamed:
                yield from messages(value, cls)
                return
            system, name = _file_system(value)
            with system.open_input_stream(name) as f:
                yield from messages(f, cls)

        for batch in batches:
            rows = []
            for value in batch.column(0).to_pylist():
                if json_lines:
                    if value.strip():
                        rows.append(to_python(json_format.Parse(value, cls())))
                    continue
                for m in of_file(value):
                    rows.append(to_python(m))
                    if len(rows) >= 10_000:
                        yield from pa.Table.from_pylist(rows, target).to_batches()
                        rows = []
            if rows:
                yield from pa.Table.from_pylist(rows, target).to_batches()

    return files.mapInArrow(parse, schema)


class _Writer(DataSourceWriter):
    """Tasks write below _temporary, the driver gives committed parts their names: on the file system of the path's URI."""

    def __init__(self, path: str, descriptors: bytes, message: str, json_lines: bool):
        self.path, self.descriptors, self.message, self.json_lines = path, descriptors, message, json_lines

    def _place(self):
        system, path = _file_system(self.path)
        return system, path.rstrip("/")

    def write(self, rows) -> WriterCommitMessage:
        import uuid

        from google.protobuf import json_format

        cls, (system, path) = message_class(self.descriptors, self.message), self._place()
        name = f"part-{uuid.uuid4().hex}.{'jsonl' if self.json_lines else 'pb'}"
        system.create_dir(f"{path}/_temporary", recursive=True)
        with system.open_output_stream(f"{path}/_temporary/{name}") as out:
            for row in rows:
                m = from_python(cls(), row.asDict())
                out.write((json_format.MessageToJson(m, indent=None) + "\n").encode() if self.json_lines else delimited(m))
        message = WriterCommitMessage()
        message.name = name
        return message

    def commit(self, messages) -> None:
        # Only what committed attempts wrote gets its name; others' files go with the folder.
        system, path = self._place()
        system.create_dir(path, recursive=True)
        for m in messages:
            if m is not None:
                system.move(f"{path}/_temporary/{m.name}", f"{path}/{m.name}")
        self.abort(messages)

    def abort(self, messages) -> None:
        from pyarrow import fs

        system, path = self._place()
        if system.get_file_info(f"{path}/_temporary").type == fs.FileType.Directory:
            system.delete_dir(f"{path}/_temporary")


def write_protobuf(df: DataFrame, path: str, descriptors: bytes, message: str, json_lines: bool = False) -> None:
    """Messages of the rows, columns without a field skipped, into a folder: a local path or a URI that pyarrow opens (hdfs, s3, gs, file)."""

    class Sink(DataSource):
        @classmethod
        def name(cls) -> str:
            return "weirflow_protobuf"

        def writer(self, schema, overwrite: bool) -> DataSourceWriter:
            return _Writer(path, descriptors, message, json_lines)

    df.sparkSession.dataSource.register(Sink)
    df.write.format("weirflow_protobuf").mode("append").save()
