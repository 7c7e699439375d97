"""Benchmark decontamination by greedy string tiling.

Words are lower-cased runs of letters and digits. Running Karp-Rabin hashes of all runs of `seed` words of a document are
looked up among those of the benchmark items; a shared seed makes a pair of document and item. Seeds on one diagonal join
to maximal matches. The longest match whose words are not marked yet is marked, again and again, down to `seed` words;
what is marked of an item is its coverage, whatever the order of its passages in the document.

The benchmark is the stated query set: it is held in blocks of at most BLOCK_CHARS characters, each broadcast by itself,
and every block sees every document. Documents are neither shuffled nor joined. What is listed at once is the shared seeds of
one document and one item, at most SEED_PAIRS; where repeated words make more, the same tiles are found by scans instead.

Defined results: null or empty texts on either side match nothing; items of fewer than `seed` words have no tiles;
repeated rows are each reported; an item without id is reported with a null item_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, hashes_of, inside, slices, words_of

SEED = 5
#: A document with this share of an item's words in tiles is contaminated by it.
COVERAGE = 0.5
BLOCK_CHARS = 16_000_000
#: Shared seeds (places in the document times places in the item) that are listed at once.
SEED_PAIRS = 1 << 20


def normal(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\pL\pN]+", " ")


def tiles(doc: np.ndarray, item: np.ndarray, at: np.ndarray, of: np.ndarray, seed: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in doc, start in item, words), longest first. at, of: where seeds of both begin, all of them."""
    order = np.lexsort((at, at - of))
    at, of = at[order], of[order]
    new = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(at - of) != 0)])
    first = np.flatnonzero(new)
    runs = [(int(n) + seed - 1, int(at[i]), int(of[i])) for i, n in zip(first, np.diff(np.append(first, len(at))), strict=True)]
    import heapq

    heap = [(-n, i, j) for n, i, j in runs]
    heapq.heapify(heap)
    marked_doc, marked_item = set(), set()
    out = []
    while heap:
        n, i, j = heapq.heappop(heap)
        n = -n
        taken = [k for k in range(n) if i + k in marked_doc or j + k in marked_item]
        if not taken:
            out.append((i, j, n))
            marked_doc.update(range(i, i + n))
            marked_item.update(range(j, j + n))
            if len(marked_item) > len(item) - seed:
                break
            continue
        for a, b in zip([-1, *taken], [*taken, n], strict=True):
            if b - a - 1 >= seed:
                heapq.heappush(heap, (-(b - a - 1), i + a + 1, j + a + 1))
    return out


def scanned_tiles(doc: np.ndarray, item: np.ndarray, seed: int) -> list[tuple[int, int, int]]:
    """The same tiles as tiles(), without a list of shared seeds: for texts that repeat a few words thousands of times.

    The longest match of words not marked yet is found by halving its length: the Karp-Rabin hashes of all unmarked runs of
    a length in one text are looked up among those of the other. Memory is that of the texts.
    """
    hashes = Rolling(doc), Rolling(item)
    marked = np.zeros(len(doc), dtype=np.int64), np.zeros(len(item), dtype=np.int64)
    out: list[tuple[int, int, int]] = []

    def shared(n: int) -> tuple[int, int] | None:
        """Where the first unmarked run of n words that both have begins, in the document and in the item."""
        runs, free = [], []
        for h, m in zip(hashes, marked, strict=True):
            sums = np.concatenate([[0], np.cumsum(m)])
            runs.append(h.runs(n))
            free.append(np.flatnonzero(sums[n:] == sums[: len(sums) - n]))
        if not len(free[0]) or not len(free[1]):
            return None
        theirs = runs[1][free[1]]
        found = np.flatnonzero(np.isin(runs[0][free[0]], theirs))
        if not len(found):
            return None
        i = int(free[0][found[0]])
        return i, int(free[1][np.flatnonzero(theirs == runs[0][i])[0]])

    most = min(len(doc), len(item))
    while most >= seed and (best := shared(seed)):
        low, high = seed, most
        while low < high:
            middle = (low + high + 1) // 2
            at = shared(middle)
            low, high, best = (middle, high, at) if at else (low, middle - 1, best)
        i, j = best
        out.append((i, j, low))
        marked[0][i : i + low] = 1
        marked[1][j : j + low] = 1
        most = low
        if marked[1].sum() > len(item) - seed:
            break
    return out


class Items:
    """One block of the benchmark, ready for lookups."""

    def __init__(self, ids: list, texts: list, seed: int):
        self.ids, self.seed = ids, seed
        words, bounds = words_of(normal(pa.array(texts, pa.string())))
        self.words, self.bounds = hashes_of(words.dictionary)[np.asarray(words.indices)], bounds
        runs = Rolling(self.words).runs(seed)
        start = np.flatnonzero(inside(bounds, seed))
        order = np.argsort(runs[start], kind="stable")
        self.hash, self.start = runs[start][order], start[order]
        self.item = np.searchsorted(bounds, self.start, side="right") - 1
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[self.hash >> np.uint64(44)] = True

    def found(self, texts: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item's place, item's words, words in tiles, tiles) for every pair that shares a seed."""
        if not len(self.hash):
            return
        for first, part in slices(texts):
            words, bounds = words_of(normal(part))
            own = hashes_of(words.dictionary)[np.asarray(words.indices)]
            runs = Rolling(own).runs(self.seed)
            at = np.flatnonzero(self.maybe[runs >> np.uint64(44)] & inside(bounds, self.seed))
            low, high = np.searchsorted(self.hash, runs[at], "left"), np.searchsorted(self.hash, runs[at], "right")
            at, low, count = at[high > low], low[high > low], (high - low)[high > low]
            if not len(at):
                continue
            # Documents one after another, so that what is listed at once is one document's.
            rows = np.searchsorted(bounds, at, side="right") - 1
            cuts = np.flatnonzero(np.diff(rows, prepend=-1))
            for a, b in zip(cuts, np.append(cuts[1:], len(at)), strict=True):
                row = rows[a]
                doc = own[bounds[row] : bounds[row + 1]]
                for k, cover in self._covers(doc, at[a:b] - bounds[row], low[a:b], count[a:b]):
                    yield first + int(row), k, int(self.bounds[k + 1] - self.bounds[k]), sum(t[2] for t in cover), len(cover)

    def _covers(self, doc: np.ndarray, at: np.ndarray, low: np.ndarray, count: np.ndarray) -> Iterator[tuple[int, list]]:
        """Tiles of each item that shares seeds with a document. at: their places in it; low, count: where each stands in the index."""
        # Each distinct seed's entries once, and how often the document has it: items by the pairs of places that they share.
        seeds, which, times = np.unique(low, return_inverse=True, return_counts=True)
        size = np.zeros(len(seeds), dtype=np.int64)
        size[which] = count
        entry = np.repeat(seeds - np.cumsum(size) + size, size) + np.arange(size.sum())
        seed_of, item_of = np.repeat(np.arange(len(seeds)), size), self.item[entry]
        order = np.argsort(item_of, kind="stable")
        places, begin = np.argsort(which, kind="stable"), np.cumsum(times) - times
        for part in np.split(order, np.flatnonzero(np.diff(item_of[order])) + 1):
            k, own = int(item_of[part[0]]), seed_of[part]
            item, start = self.words[self.bounds[k] : self.bounds[k + 1]], self.start[entry[part]] - self.bounds[k]
            n = times[own]
            if n.sum() > SEED_PAIRS:
                yield k, scanned_tiles(doc, item, self.seed)
                continue
            here = at[places[np.repeat(begin[own] - np.cumsum(n) + n, n) + np.arange(n.sum())]]
            yield k, tiles(doc, item, here, np.repeat(start, n), self.seed)


def blocks(benchmark: DataFrame, item_id: str, text: str, seed: int) -> Iterator[Items]:
    ids, texts, size = [], [], 0
    for row in benchmark.select(F.col(item_id).alias("i"), F.col(text).cast("string").alias("t")).toLocalIterator():
        if texts and size + len(row.t or "") > BLOCK_CHARS:
            yield Items(ids, texts, seed)
            ids, texts, size = [], [], 0
        ids.append(row.i)
        texts.append(row.t or "")
        size += len(row.t or "")
    if texts:
        yield Items(ids, texts, seed)


def contaminated(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id") -> DataFrame:
    """One row for each document and item that it covers: doc_id, item_id, coverage, item_words, matched_words, n_tiles."""
    spark = docs.sparkSession
    kinds = dict(docs.select(F.col(doc_id).alias("d")).dtypes)["d"], dict(benchmark.select(F.col(item_id).alias("i")).dtypes)["i"]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, coverage double, item_words long, matched_words long, n_tiles long"
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = None
    for items in blocks(benchmark, item_id, text, seed):
        held = spark.sparkContext.broadcast(items)

        def scan(batches, held=held):
            items = held.value
            for batch in batches:
                pairs = [x for x in items.found(batch.column(1)) if x[3] >= coverage * x[2]]
                if pairs:
                    row, k, size, hit, n = map(np.array, zip(*pairs, strict=True))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array([items.ids[i] for i in k], type=None), pa.array(hit / size), pa.array(size), pa.array(hit), pa.array(n)], ["doc_id", "item_id", "coverage", "item_words", "matched_words", "n_tiles"])

        part = narrow.mapInArrow(scan, schema)
        out = part if out is None else out.unionAll(part)
    return out if out is not None else spark.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """docs without the rows that cover an item; all columns, no shuffle."""
    for items in blocks(benchmark, item_id, text, seed):
        held, place = docs.sparkSession.sparkContext.broadcast(items), docs.columns.index(text)

        def keep(batches, held=held, place=place):
            for batch in batches:
                texts = batch.column(place)
                stays = np.ones(batch.num_rows, dtype=bool)
                for row, _, size, hit, _ in held.value.found(texts if pa.types.is_string(texts.type) else texts.cast(pa.string())):
                    stays[row] &= hit < coverage * size
                yield batch.filter(pa.array(stays))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
