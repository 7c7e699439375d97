"""Approximate nearest neighbours by inner product: inverted lists, scanned adaptively by dimension.

Vectors get one more component, sqrt(M * M - |x| * |x|) with M the largest norm (queries: 0), so that the nearest by distance is
the one of the largest inner product. K-means on a bounded sample (SAMPLE_FLOATS numbers, by the hash of the vector) gives
the lists; every vector is put in its nearest list. How many lists a query probes is measured, not set: enough to hold AIM of
the true neighbours that sampled queries have among the sample, whose neighbours are farther off than those of the whole
table. Vectors with little structure need about half of all lists, clustered ones few.

In a list, vectors are turned by a random rotation and held by blocks of columns. After each block of columns the partial
distances of all pairs of a tile of queries and vectors, scaled up, are tested against the distance of the k-th best that the
query has found so far: a pair that is farther by more than the rotation's spread allows (EPSILON) is given up, a tile
without pairs ends, and one with few is finished pair by pair. What is left is ranked by the exact inner product of the
original vectors in double precision. The bound starts from a query's nearest lists, which are scanned first, and tightens
from list to list within a task; so a query hands on few candidates, however many lists it probes.

The queries are the stated set: they go out in blocks of QUERY_BYTES, each of which is a broadcast to the tasks that read the
lists. Tables are cut by list and key, so a long list is many tasks. Equal vectors are one candidate with its k + 1 smallest
ids (no other can be among a query's k nearest), and one query.

Defined results: rows without vec_id or whose vector is null, zero, or holds nulls or non-finite numbers take no part, nor
do vectors of another length than most have; of rows that repeat a vec_id the smallest vector counts; other columns, of
whatever names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release, stage, tidy, trim

K, QUERY_MODULUS = 20, 20
SAMPLE_FLOATS, MOST_LISTS, SAMPLE_QUERIES = 2_000_000, 4096, 512
#: The share of the sample's true neighbours that probed lists hold, and of all lists those that are scanned first.
AIM, FIRST_SHARE = 0.97, 0.02
COLUMNS, EPSILON = 16, 2.1
#: Queries of a tile; the share of its pairs below which these are finished one by one; bytes of the queries of one broadcast.
TILE_ROWS, FEW, QUERY_BYTES = 256, 0.02, 16 << 20
FOUND = "key string, ids array<bigint>, score double"
#: How tables of vectors are written: their numbers neither repeat nor compress.
DENSE = {"compression": "none", "parquet.enable.dictionary": "false"}


def valid_vectors(table: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v, key): rows that take part, v in double precision; key stands for the vector."""
    rows = table.select(F.col(vec_id).alias("vec_id"), F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0)).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    most = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).agg(F.max_by("d", F.struct("n", "d")).alias("d"))
    return rows.join(F.broadcast(most), F.size("v") == F.col("d")).select("vec_id", "v", F.concat(F.hex(F.xxhash64("v")), F.lit("-"), F.hex(F.xxhash64(F.lit(1), "v"))).alias("key"))


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The nearest center of each row."""
    norms = (centers * centers).sum(axis=1)
    return np.concatenate([(norms - 2 * x[i : i + 2048] @ centers.T).argmin(axis=1) for i in range(0, len(x), 2048)])


def kmeans(x: np.ndarray, lists: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    centers = x[np.random.default_rng(seed).permutation(len(x))[:lists]].copy()
    for _ in range(rounds):
        near = nearest(x, centers)
        count = np.bincount(near, minlength=len(centers))
        order = np.argsort(near, kind="stable")
        used = np.flatnonzero(count)
        sums = np.add.reduceat(x[order], (np.cumsum(count) - count)[used], axis=0)
        centers[used] = sums / count[used, None]
    return centers


def probes_for(x: np.ndarray, wide: np.ndarray, centers: np.ndarray, k: int, aim: float = AIM, most: int = SAMPLE_QUERIES) -> int:
    """How many lists queries must probe to meet that share of their k nearest among x. wide: x with its last component."""
    n, k = min(most, len(x)), min(k, len(x) - 1)
    if k < 1:
        return len(centers)
    score = x[:n] @ x.T
    score[np.arange(n), np.arange(n)] = -np.inf
    top = np.argpartition(-score, k - 1, axis=1)[:, :k]
    far = (centers * centers).sum(axis=1) - 2 * x[:n] @ centers[:, :-1].T
    place = np.argsort(np.argsort(far, axis=1, kind="stable"), axis=1)
    return int(np.quantile(place[np.arange(n)[:, None], nearest(wide, centers)[top]], aim, method="higher")) + 1


def probed(lists: np.ndarray, held_by: np.ndarray, probes: int, least: int) -> np.ndarray:
    """Which of its lists, nearest first, a query goes to: the first probes, and further ones until they hold least vectors."""
    before = np.cumsum(held_by[lists], axis=1) - held_by[lists]
    return (np.arange(lists.shape[1]) < probes) | (before < least)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), d)


class Block:
    """Vectors of one list, by blocks of rotated columns."""

    def __init__(self, vectors: np.ndarray, ids: list, rotation: np.ndarray, square: float):
        self.vectors, self.ids, self.smallest = vectors, ids, np.array([x[0] for x in ids], dtype=np.int64)
        more = np.sqrt(np.maximum(square - (vectors * vectors).sum(axis=1), 0))[:, None]
        turned = (np.hstack([vectors, more]) @ rotation).astype(np.float32)
        self.cuts = column_cuts(turned.shape[1])
        self.columns = [np.ascontiguousarray(turned[:, a:b]) for a, b in self.cuts]
        self.squares = [(c * c).sum(axis=1) for c in self.columns]

    def survivors(self, turned: np.ndarray, limits: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, vector) of a tile that no test gives up. limits: the squared distances of the queries' k-th best."""
        m, n, width = len(turned), len(self.vectors), turned.shape[1]
        partial, alive = np.zeros((m, n), dtype=np.float32), np.ones((m, n), dtype=bool)
        for step, (a, b) in enumerate(self.cuts):
            q, c = turned[:, a:b], self.columns[step]
            more = q @ c.T
            more *= -2
            more += self.squares[step]
            more += (q * q).sum(axis=1)[:, None]
            partial += more
            alive &= partial <= _allowed(limits, b, width, epsilon)[:, None]
            left = np.count_nonzero(alive)
            if not left:
                break
            if left < FEW * m * n and b < width:
                i, j = np.nonzero(alive)
                far = partial[i, j]
                for (a, b), c in zip(self.cuts[step + 1 :], self.columns[step + 1 :], strict=True):
                    diff = turned[i, a:b] - c[j]
                    far = far + np.einsum("ij,ij->i", diff, diff)
                    keep = far <= _allowed(limits, b, width, epsilon)[i]
                    i, j, far = i[keep], j[keep], far[keep]
                return i, j
        return np.nonzero(alive)


def column_cuts(width: int) -> list[tuple[int, int]]:
    """Blocks of COLUMNS columns; the last one also has what remains."""
    starts = list(range(0, max(width - COLUMNS, 0) + 1, COLUMNS))
    return list(zip(starts, [*starts[1:], width], strict=True))


def _allowed(limits: np.ndarray, seen: int, width: int, epsilon: float) -> np.ndarray:
    """The largest partial distance over so many columns that may still end within the limit; over all of them, but for single precision."""
    return (limits * (seen / width) * (1 + epsilon / np.sqrt(seen)) ** 2 if seen < width else limits * (1 + 1e-4) + 1e-5).astype(np.float32)


class Queries:
    """A block of queries: keys, vectors, how far the lists of either round may be, and bounds (scores of the k-th best so far)."""

    def __init__(self, keys: list, vectors: np.ndarray, first: np.ndarray, last: np.ndarray, rotation: np.ndarray, square: float):
        self.keys, self.vectors, self.first, self.last = keys, vectors, first, last
        self.turned = (np.hstack([vectors, np.zeros((len(vectors), 1))]) @ rotation).astype(np.float32)
        self.square = (vectors * vectors).sum(axis=1) + square
        self.bounds = np.full(len(vectors), -np.inf)


def _scan(batches, held: Broadcast, fitted: Broadcast, first_round: bool, k: int):
    """Rows by list: (key, ids, v, list), v the packed doubles. Gives (key, ids, score) of what may be among a query's k best."""
    queries, (centers, rotation, square) = held.value, fitted.value
    best = np.full((len(queries.keys), k), -np.inf)
    best[:, 0] = queries.bounds
    bounds, d = queries.bounds.copy(), queries.vectors.shape[1]
    norms = (centers * centers).sum(axis=1)
    for batch in batches:
        lists = np.asarray(batch.column(3))
        cuts = np.flatnonzero(np.diff(lists, prepend=-1, append=-1))
        out: list[tuple] = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            far = norms[lists[a]] - 2 * queries.vectors @ centers[lists[a], :-1]
            who = np.flatnonzero(far <= queries.first if first_round else (far > queries.first) & (far <= queries.last))
            if not len(who):
                continue
            part = batch.slice(a, b - a)
            block = Block(np.frombuffer(b"".join(part.column(2).to_pylist())).reshape(-1, d), part.column(1).to_pylist(), rotation, square)
            for at in range(0, len(who), TILE_ROWS):
                mine = who[at : at + TILE_ROWS]
                # What rounding takes from a bound must not give up a candidate that ties with it.
                i, j = block.survivors(queries.turned[mine], np.maximum(queries.square[mine] - 2 * bounds[mine], 0))
                score = np.concatenate([(block.vectors[j[x : x + 65_536]] * queries.vectors[mine[i[x : x + 65_536]]]).sum(axis=1) for x in range(0, len(i), 65_536)] or [np.zeros(0)])
                keep = score >= bounds[mine[i]]
                i, j, score = i[keep], j[keep], score[keep]
                order = np.lexsort((block.smallest[j], -score, i))
                i, j, score = i[order], j[order], score[order]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                keep = place < k
                i, j, score, place = i[keep], j[keep], score[keep], place[keep]
                out += [(queries.keys[mine[x]], block.ids[y], float(s)) for x, y, s in zip(i, j, score, strict=True)]
                rows = np.unique(i)
                if len(rows):
                    both = np.full((len(mine), k), -np.inf)
                    both[i, place] = score
                    best[mine[rows]] = -np.sort(-np.hstack([best[mine[rows]], both[rows]]), axis=1)[:, :k]
                    bounds[mine[rows]] = np.maximum(bounds[mine[rows]], best[mine[rows], k - 1])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out]), pa.array([x[1] for x in out], pa.list_(pa.int64())), pa.array([x[2] for x in out])], ["key", "ids", "score"])
        trim()


def search(table: DataFrame, k: int = K, modulus: int = QUERY_MODULUS, vec_id: str = "vec_id", vector: str = "embedding", most_lists: int = MOST_LISTS, aim: float = AIM) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row whose id is divisible by modulus."""
    spark, schema = table.sparkSession, "query_id bigint, rank int, vec_id bigint, score double"
    rows = stage(valid_vectors(table, vec_id, vector), "ann-vectors", **DENSE)
    first = Window.partitionBy("key").orderBy("vec_id")
    few = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    each = stage(few.groupBy("key").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("v").alias("v")), "ann-distinct", **DENSE)
    facts = each.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("square"), F.first(F.size("v")).alias("d")).head()
    if not facts.n:
        return spark.createDataFrame([], schema)
    d, square = facts.d, facts.square
    sample = _matrix(each.orderBy("key").limit(max(1, SAMPLE_FLOATS // d)).select("v").toArrow()["v"].combine_chunks(), d)
    wide = np.hstack([sample, np.sqrt(np.maximum(square - (sample * sample).sum(axis=1), 0))[:, None]])
    centers = kmeans(wide, min(most_lists, max(1, int(facts.n**0.5)), max(1, len(sample) // 8)))
    probes = probes_for(sample, wide, centers, k, aim)
    rotation = np.linalg.qr(np.random.default_rng(5).normal(size=(d + 1, d + 1)))[0]
    fitted = spark.sparkContext.broadcast((centers, rotation, square))

    def assign(batches):
        centers, _, square = fitted.value
        for batch in batches:
            x = _matrix(batch.column(2), d)
            more = np.sqrt(np.maximum(square - (x * x).sum(axis=1), 0))[:, None]
            packed = pa.array([row.tobytes() for row in x], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed, pa.array(nearest(np.hstack([x, more]), centers).astype(np.int32))], ["key", "ids", "v", "list"])

    placed = each.select("key", "ids", "v").mapInArrow(assign, "key string, ids array<bigint>, v binary, list int")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lists = stage(placed.repartitionByRange(parts, "list", "key").sortWithinPartitions("list", "key"), "ann-lists", **DENSE)
    held_by = np.zeros(len(centers), dtype=np.int64)
    for row in lists.groupBy("list").agg(F.sum(F.size("ids")).alias("n")).collect():  # a row for each list: at most most_lists
        held_by[row["list"]] = row["n"]
    near = max(1, int(np.ceil(len(centers) * FIRST_SHARE)))

    def reach(batches):
        centers, *_ = fitted.value
        norms = (centers * centers).sum(axis=1)
        for batch in batches:
            x = _matrix(batch.column(1), d)
            ends = np.zeros((2, len(x)))
            for i in range(0, len(x), 512):
                far = norms - 2 * x[i : i + 512] @ centers[:, :-1].T
                order = np.argsort(far, axis=1, kind="stable")
                far = np.take_along_axis(far, order, axis=1)
                for way, (n, least) in enumerate(((near, 2 * k), (probes, k + 1))):
                    ends[way, i : i + 512] = np.where(probed(order, held_by, n, least), far, -np.inf).max(axis=1)
            # A list that both rounds reach is the first one's.
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ends[0]), pa.array(ends.max(axis=0))], ["key", "v", "first", "last"])

    asked = rows.where(F.col("vec_id") % modulus == 0).select("vec_id", "key")
    wanted = asked.select("key").distinct().join(each.select("key", "v"), "key")
    blocks = max(1, -(-asked.count() * d * 8 // QUERY_BYTES))
    wanted = stage(wanted.mapInArrow(reach, "key string, v array<double>, first double, last double").withColumn("block", F.pmod(F.xxhash64(F.lit(7), "key"), F.lit(blocks))), "ann-queries", **DENSE)
    tables = []
    for block in range(blocks):
        # QUERY_BYTES of queries, about, reach the driver at a time.
        got = wanted.where(F.col("block") == block).toArrow()
        if not got.num_rows:
            continue
        queries = Queries(got["key"].to_pylist(), _matrix(got["v"].combine_chunks(), d), np.asarray(got["first"]), np.asarray(got["last"]), rotation, square)
        near_ones = _round(lists, queries, fitted, True, k + 1)
        told = near_ones.groupBy("key").agg(F.count("*").alias("n"), F.min("score").alias("score")).where(F.col("n") > k).toArrow()
        where = {key: i for i, key in enumerate(queries.keys)}
        for key, score in zip(told["key"].to_pylist(), told["score"].to_pylist(), strict=True):
            queries.bounds[where[key]] = score
        tables += [near_ones, _round(lists, queries, fitted, False, k + 1)]
    tidy(spark, fitted)
    release(each, lists, wanted)
    if not tables:
        return spark.createDataFrame([], schema)
    found = spark.read.schema(FOUND).parquet(*(t._weirflow_path for t in tables))  # one relation, however many blocks
    pairs = asked.join(_best(found, k + 1), "key").select(F.col("vec_id").alias("query_id"), F.explode("ids").alias("vec_id"), "score").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _best(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("key").orderBy(F.desc("score"), F.col("ids")[0])
    return found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).select("key", "ids", "score")


def _round(lists: DataFrame, queries: Queries, fitted: Broadcast, first: bool, k: int) -> DataFrame:
    """(key, ids, score), staged: of one block of queries the k best of one round's lists that reach the bounds."""
    held = lists.sparkSession.sparkContext.broadcast(queries)
    out = stage(_best(lists.mapInArrow(lambda batches: _scan(batches, held, fitted, first, k), FOUND), k), "ann-found")
    held.destroy()
    return out


def op6_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
