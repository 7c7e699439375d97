"""What the operators of this subpackage share: staged tables, checked broadcasts, words and hashes."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from py4j.protocol import Py4JJavaError
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of anything but these six characters (Java, RE2 and Python read it alike).
WORD = r"[^\x20\x09-\x0D]+"
#: Odd multipliers of the Karp-Rabin hashes, and their inverses modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of a counted side (see size_of) up to which a join is a broadcast; beyond them it is shuffled.
BROADCAST_BYTES = 32 << 20

_local_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local_folder:
        _local_folder.append("file://" + tempfile.mkdtemp(prefix="weirflow-"))
    return _local_folder[0]


def stage(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts the lineage, survives lost executors. options: the writer's."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/weirflow/{label}-{uuid.uuid4().hex}"
    df.write.options(**{"compression": "zstd"} | options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weirflow_path = path
    for made in _collecting:
        made.append(out)
    return out


_collecting: list[list[DataFrame]] = []


@contextmanager
def temporary():
    """Tables of stage() made inside are deleted at the end; take out of the given list what is to stay."""
    made: list[DataFrame] = []
    _collecting.append(made)
    try:
        yield made
    finally:
        _collecting.remove(made)
        release(*made)


def release(*tables: DataFrame) -> None:
    """Deletes tables of stage() that no later plan reads."""
    for df in tables:
        path = getattr(df, "_weirflow_path", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def size_of(df: DataFrame) -> int:
    """The bytes that df takes as a broadcast table, about: what is in its columns, and ROW_BYTES a row."""

    def width(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0))
        if isinstance(kind, T.ArrayType):
            return F.coalesce(F.size(c), F.lit(0)) * 8 if isinstance(kind.elementType, T.NumericType) else F.coalesce(F.aggregate(c, F.lit(0), lambda n, x: n + 8 + width(x, kind.elementType)), F.lit(0))
        return F.lit(8)

    total = sum((width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(ROW_BYTES))
    return df.agg(F.coalesce(F.sum(total.cast("long")), F.lit(0))).head()[0]


#: What a row of a broadcast table takes beside its columns: its key, header, place in the hash table.
ROW_BYTES = 96


def join_checked(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Joins with a broadcast of right only if its measured bytes are within BROADCAST_BYTES; else a shuffled join, whose skew AQE splits.

    right must be staged or cheap, as it is measured.
    """
    return left.join(F.broadcast(right) if size_of(right) <= BROADCAST_BYTES else right.hint("merge"), on, how)


def text_of(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def key_of(text: Column) -> Column:
    """What stands for a text: its MD5, 16 bytes."""
    return F.unhex(F.md5(text_of(text).cast("binary")))


def id_text(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


# --- numpy side -------------------------------------------------------------


try:
    _malloc_trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another libc
    _malloc_trim = None


def trim() -> None:
    """Gives freed memory back to the system: workers are reused, and the heap of one operator is no use to the next."""
    pa.default_memory_pool().release_unused()
    if _malloc_trim:
        _malloc_trim(0)


def tidy(spark: SparkSession, *done: Broadcast) -> None:
    """Gives back what finished steps of a long operator hold on the driver: its broadcasts, which no later plan reads, and freed memory.

    Python's objects go first, as they keep the JVM's alive; with those Spark's own cleaner drops shuffles and broadcasts.
    What the allocators then hold in reserve, in either process, goes back to the system.
    """
    for held in done:
        held.destroy()
    gc.collect()
    trim()
    jvm, objects = spark._jvm, spark.sparkContext._gateway.new_array(spark._jvm.java.lang.Object, 4)
    jvm.System.gc()
    objects[0], objects[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    # By the interface, as the class that answers isn't public.
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    try:
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), objects)
    except Py4JJavaError:  # a JVM without the command
        pass


def slices(texts: pa.Array, limit: int = 2 << 20):
    """Cuts a batch of texts at about limit bytes, so that numpy's arrays stay small; one document is never cut."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield start, texts.slice(start, stop - start)
        start = stop
    trim()


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts as one dictionary array, and where each text's words begin (one more entry than texts)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, at = parts.flatten(), np.asarray(pc.fill_null(pc.list_value_length(parts), 0), dtype=np.int64)
    full = np.asarray(pc.binary_length(flat)) > 0
    owner = np.repeat(np.arange(len(at)), at)[full]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(at)))])
    return flat.filter(pa.array(full)).dictionary_encode(), bounds


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers (the murmur3 finalizer)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def hashes_of(words: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hashes of distinct words."""
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w, seed) for w in words.cast(pa.binary()).to_pylist()), dtype=np.uint64, count=len(words))


class Rolling:
    """Karp-Rabin over a sequence of 64-bit word hashes: the hash of any run of words in O(1), all runs of one length at once."""

    def __init__(self, word_hashes: np.ndarray, powers: list | None = None):
        n = len(word_hashes)
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BASE, dtype=np.uint64)]))
            self.inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BASE_INVERSE, dtype=np.uint64)]))
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(word_hashes * self.power[:n])])
        self.n = n

    def runs(self, k: int) -> np.ndarray:
        """Hashes of the words i .. i+k-1 for every i."""
        m = self.n - k + 1
        if m <= 0:
            return np.empty(0, dtype=np.uint64)
        with np.errstate(over="ignore"):
            return mixed((self.sums[k : k + m] - self.sums[:m]) * self.inverse[:m])


def inside(bounds: np.ndarray, k: int) -> np.ndarray:
    """For runs of k words over concatenated documents: which of them lie within one document."""
    n = int(bounds[-1])
    if n < k:
        return np.zeros(0, dtype=bool)
    ends = np.repeat(bounds[1:], np.diff(bounds))
    return np.arange(n - k + 1) + k <= ends[: n - k + 1]


CHUNKS = "chunk int, sums binary"


def emit_chunks(total: np.ndarray, width: int) -> pa.RecordBatch:
    """A vector's non-zero stretches of width numbers, as rows of CHUNKS."""
    used = [i for i in range(0, len(total), width) if total[i : i + width].any()]
    return pa.RecordBatch.from_arrays([pa.array([i // width for i in used], pa.int32()), pa.array([total[i : i + width].tobytes() for i in used], pa.binary())], ["chunk", "sums"])


def add_chunks(parts: DataFrame, size: int, width: int, dtype) -> np.ndarray:
    """The sum of vectors that tasks gave as CHUNKS. Added up on executors in a fixed number of tasks; one vector reaches the driver."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, sums in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total[chunk] = total.get(chunk, 0) + np.frombuffer(sums.as_buffer(), dtype=dtype)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["chunk", "sums"])

    rows = parts.repartition(16, "chunk").mapInArrow(add, CHUNKS).toArrow()
    out = np.zeros(size, dtype=dtype)
    for chunk, sums in zip(rows["chunk"].to_pylist(), rows["sums"].to_pylist(), strict=True):
        got = np.frombuffer(sums, dtype=dtype)
        out[chunk * width : chunk * width + len(got)] = got
    return out
