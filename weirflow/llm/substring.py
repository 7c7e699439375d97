"""Substring dedup by seed and extend: winnowed anchors, extended both ways to runs of LENGTH words that repeat.

Anchors: in every run of LENGTH words the run of SEED words with the smallest Karp-Rabin hash (the leftmost, if several) is
the run's anchor, so equal runs have equal anchors at equal places. Occurrences of an anchor anywhere in the corpus are
joined by its hash; those without a second one end there. The others are extended to both sides: every run of LENGTH words
around the seed that has it as its anchor is compared, by hash, with the runs around all other occurrences at once.
What repeats is covered, and neighbouring runs join to maximal repeats. A group of n occurrences so costs n rows, never
n * n pairs. Groups of at most HOT_ROWS occurrences are compared in one task; larger ones (a licence line in a third of all
documents) in parts of PART_ROWS to twice as many, and what is alone in its part is then looked up among all others' runs.

A text's key is its MD5, and equal texts have equal results, so copies are seeded once a task; texts that occur twice are
repeats from end to end. Runs are equal if their hash of 64 bits and that of their anchor are.

Texts are shuffled by their keys twice, at every size: to their seeds and to their repeats. Both of these are tables of their
own, so that Spark splits a text that a third of all rows hold.

Defined results: null and empty texts have no words; texts shorter than LENGTH lose nothing; repeated rows are copies.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Rolling, hashes_of, inside, key_of, release, slices, stage, text_of, trim, words_of

LENGTH, SEED = 35, 16
HOT_ROWS, PART_ROWS = 1024, 64


def _anchors(own: np.ndarray, bounds: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """Of each anchor in order: its hash, its text, its number within the text, its first and last run of words; and all runs' hashes."""
    roll = Rolling(own)
    value, runs = roll.runs(seed), roll.runs(length)
    starts = np.flatnonzero(inside(bounds, length))
    if not len(starts):
        return (*(np.zeros(0, dtype=np.int64) for _ in range(5)), runs)
    best, place, width, step = value, np.arange(len(value)), 1, 1
    while width < length - seed + 1:
        step = min(width, length - seed + 1 - width)
        right, n = best[step:], len(best) - step
        less = right < best[:n]
        best, place = np.where(less, right, best[:n]), np.where(less, place[step:], place[:n])
        width += step
    at = place[starts]
    text = np.searchsorted(bounds, starts, side="right") - 1
    first = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
    last = np.append(first[1:], len(starts)) - 1
    text = text[first]
    number = np.arange(len(first)) - np.searchsorted(text, text, side="left")
    return value[at[first]].view(np.int64), text, number, starts[first], starts[last], runs


def _lists(values: np.ndarray, counts: np.ndarray, kind=pa.int64()) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))


#: A mark is an anchor's number in its text, times so many, plus its level.
LEVELS = 64


def _level(times: Column) -> Column:
    """0 for anchors that aren't hot; for those of 2^level / 2 parts of PART_ROWS rows and more, level."""
    return F.when(times > HOT_ROWS, F.greatest(F.lit(0), F.floor(F.log2(times / PART_ROWS))) + 1).otherwise(0).cast("bigint")


def _seeds(keyed: DataFrame, length: int, seed: int) -> DataFrame:
    """(key, marks): for texts with anchors that occur again, their marks."""

    def scan(batches):
        seen: set[bytes] = set()
        for batch in batches:
            for first, part in slices(batch.column(1)):
                keys = batch.column(0).slice(first, len(part))
                fresh = np.array([k not in seen and not seen.add(k) for k in keys.to_pylist()], dtype=bool)
                part, keys = part.filter(pa.array(fresh)), keys.filter(pa.array(fresh))
                words, bounds = words_of(part)
                anchor, text, *_ = _anchors(hashes_of(words.dictionary)[np.asarray(words.indices)], bounds, length, seed)
                count = np.bincount(text, minlength=len(part))
                yield pa.RecordBatch.from_arrays([keys.filter(pa.array(count > 0)), _lists(anchor, count[count > 0])], ["key", "anchors"])

    per_text = stage(keyed.mapInArrow(scan, "key binary, anchors array<bigint>"), "substring-anchors")
    each = per_text.select("key", F.posexplode("anchors").alias("n", "anchor"))
    # A table of its own: Spark splits skewed keys of joins whose sides are plain exchanges only.
    again = stage(each.groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1").select("anchor", _level(F.col("times")).alias("level")), "substring-again")
    found = each.join(again.hint("merge"), "anchor").groupBy("key").agg(F.collect_set(F.col("n") * LEVELS + F.col("level")).alias("marks"))
    out = stage(found, "substring-seeds")
    release(per_text, again)
    return out


def _occurrences(keyed: DataFrame, seeds: DataFrame, length: int, seed: int) -> DataFrame:
    """(anchor, key, start, runs, level): of each seed, where its first run of words starts and the hashes of its runs."""

    def scan(batches):
        seen: set[bytes] = set()
        for batch in batches:
            for first, part in slices(batch.column(1)):
                keys = batch.column(0).slice(first, len(part))
                fresh = np.array([k not in seen and not seen.add(k) for k in keys.to_pylist()], dtype=bool)
                part, keys = part.filter(pa.array(fresh)), keys.filter(pa.array(fresh))
                marks = batch.column(2).slice(first, len(fresh)).filter(pa.array(fresh))
                words, bounds = words_of(part)
                anchor, text, number, start, last, runs = _anchors(hashes_of(words.dictionary)[np.asarray(words.indices)], bounds, length, seed)
                if not len(anchor):
                    continue
                base = np.searchsorted(text, np.arange(len(part)))
                flat = np.asarray(marks.flatten()).astype(np.int64)
                where = np.repeat(base, np.asarray(marks.value_lengths())) + flat // LEVELS
                count = last[where] - start[where] + 1
                inner = np.repeat(start[where] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                yield pa.RecordBatch.from_arrays([pa.array(anchor[where]), keys.take(pa.array(text[where])), pa.array((start[where] - bounds[text[where]]).astype(np.int32)), _lists(runs[inner].view(np.int64), count), pa.array((flat % LEVELS).astype(np.int32))], ["anchor", "key", "start", "runs", "level"])

    return keyed.join(seeds.hint("merge"), "key").select("key", "text", "marks").mapInArrow(scan, "anchor bigint, key binary, start int, runs array<bigint>, level int")


#: Of _extend(): bits of repeats; (alone) runs that occur once in their group, with their places; (many) runs that repeat in some group, with their anchors.
EXTENDED = "key binary, anchor bigint, start int, bits bigint, places array<int>, alone array<bigint>, many array<bigint>, anchors array<bigint>"


def _extend(batches, groups: int):
    """Rows sorted by group (the first columns, so many): bit i of bits says that the run from start + i repeats in the group.

    With more than one column a group is a part of an anchor's occurrences, so what doesn't repeat in it is handed on, and
    of what does each run once.
    """

    def compare(table: pa.Table):
        table = table.combine_chunks()
        keys, start, anchor = table["key"].combine_chunks(), np.asarray(table["start"]).astype(np.int64), np.asarray(table["anchor"])
        keys = keys if isinstance(keys, pa.Array) else keys.chunk(0)
        key = np.asarray(keys.dictionary_encode().indices)
        lists = table["runs"].combine_chunks()
        lists = lists if isinstance(lists, pa.ListArray) else lists.chunk(0)
        count = np.asarray(lists.value_lengths()).astype(np.int64)
        owner = np.repeat(np.arange(len(key)), count)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        runs = np.asarray(lists.flatten())
        group = np.cumsum(np.any([np.diff(np.asarray(table.column(i)), prepend=0) != 0 for i in range(groups)], axis=0))
        # A copy that another task has seeded again is the same place.
        order = np.lexsort((start[owner] + inner, key[owner], runs, group[owner]))
        g, r, k, s = group[owner][order], runs[order], key[owner][order], (start[owner] + inner)[order]
        new = np.ones(len(r), dtype=bool)
        new[1:] = (r[1:] != r[:-1]) | (g[1:] != g[:-1])
        place = new.copy()
        place[1:] |= (k[1:] != k[:-1]) | (s[1:] != s[:-1])
        twice = (np.bincount(np.cumsum(new) - 1, weights=place) > 1)[np.cumsum(new) - 1]
        repeats = np.zeros(len(r), dtype=bool)
        repeats[order] = twice
        bits = np.bincount(owner[repeats], weights=2.0 ** inner[repeats], minlength=len(key)).astype(np.int64)
        if groups == 1:
            some = np.flatnonzero(bits > 0)
            yield _rows(keys.take(pa.array(some)), anchor[some], start[some], bits[some])
            return
        left = np.flatnonzero(~repeats)
        yield _rows(keys, anchor, start, bits, (inner[left], runs[left], np.bincount(owner[left], minlength=len(key))), (r[new & twice], anchor[owner[order][new & twice]]))

    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        ids = [np.asarray(table.column(i)) for i in range(groups)]
        other = np.flatnonzero(np.any([x != x[-1] for x in ids], axis=0)) if table.num_rows else np.zeros(0)
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield from compare(table.slice(0, cut))
        rest = table.slice(cut)
        trim()
    if rest is not None and rest.num_rows:
        yield from compare(rest)


def _rows(key, anchor, start, bits, alone=None, many=None) -> pa.RecordBatch:
    n = len(key)
    lists = [_lists(np.zeros(0), np.zeros(n, dtype=int), pa.int32())] + [_lists(np.zeros(0), np.zeros(n, dtype=int))] * 3
    if alone is not None and n:
        # What repeats in its group stands in the first row.
        in_first = np.concatenate([[len(many[0])], np.zeros(n - 1, dtype=int)])
        lists = [_lists(alone[0].astype(np.int32), alone[2], pa.int32()), _lists(alone[1], alone[2]), _lists(many[0], in_first), _lists(many[1], in_first)]
    return pa.RecordBatch.from_arrays([key, pa.array(anchor), pa.array(np.asarray(start).astype(np.int32)), pa.array(bits), *lists], [c.split()[0] for c in EXTENDED.split(", ")])


def _intervals(batches, length: int):
    """(key, cover): the covered words as packed pairs of int32, first and end, ascending and apart."""
    for batch in batches:
        lists = batch.column(1)
        n = np.asarray(lists.value_lengths()).astype(np.int64)
        marks = lists.flatten()
        start, bits = (np.asarray(marks.field(c)) for c in ("start", "bits"))
        place, bit = np.nonzero(np.unpackbits(np.ascontiguousarray(bits, dtype="<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        # Each covered run once: its key's number and its start as one number.
        runs = np.unique((np.repeat(np.arange(len(n)), n)[place] << 32) + start[place] + bit)
        owner, at = runs >> 32, runs & 0xFFFFFFFF
        first = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(at, prepend=0) > length))
        last = np.append(first[1:], len(runs))[: len(first)] - 1
        pairs = np.stack([at[first], at[last] + length], axis=1).astype(np.int32)
        ends = np.concatenate([[0], np.cumsum(np.bincount(owner[first], minlength=len(n)))]).astype(np.int32) * 8
        covers = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(pairs.tobytes())])
        yield pa.RecordBatch.from_arrays([batch.column(0), covers], ["key", "cover"])


def repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(keyed, found): documents with their key; of each key with repeats, cover (packed intervals of words) and whole (the text occurs twice)."""
    keyed = docs.select(key_of(F.col(text)).alias("key"), text_of(F.col(text)).alias("text"))
    copies = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit(True).alias("whole"))
    seeds = _seeds(keyed, length, seed)
    places = stage(_occurrences(keyed, seeds, length, seed), "substring-places")
    tasks = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cool = places.where("level = 0").select("anchor", "key", "start", "runs").repartition(tasks, "anchor").sortWithinPartitions("anchor").mapInArrow(lambda batches: _extend(batches, 1), EXTENDED).select("key", "start", "bits")
    # Of hot anchors parts are compared by themselves, and then what was alone in its part with all others, run by run.
    # Each anchor has parts for its own occurrences: in those of the hottest one, rows of others would be alone.
    hot = places.where("level > 0").select("anchor", F.pmod(F.xxhash64("key", "start"), F.expr("shiftleft(1L, level - 1)")).alias("part"), "key", "start", "runs")
    hot = hot_parts = stage(hot.repartition(tasks, "anchor", "part").sortWithinPartitions("anchor", "part").mapInArrow(lambda batches: _extend(batches, 2), EXTENDED), "substring-hot")
    alone = hot.where("size(alone) > 0").select("key", "anchor", "start", F.explode(F.arrays_zip("places", "alone")).alias("x")).select("key", "anchor", (F.col("start") + F.col("x.places")).alias("start"), F.col("x.alone").alias("run"))
    found = alone.select("anchor", "run", F.lit(1).alias("n")).unionAll(hot.where("size(many) > 0").select(F.explode(F.arrays_zip("anchors", "many")).alias("x")).select("x.anchors", "x.many", F.lit(2)))
    twice = stage(found.groupBy("anchor", "run").agg(F.sum("n").alias("n")).where("n > 1").select("anchor", "run"), "substring-twice")
    more = alone.join(twice.hint("merge"), ["anchor", "run"]).select("key", "start", F.lit(1).cast("bigint").alias("bits"))
    hot = hot.where("bits > 0").select("key", "start", "bits").unionAll(more)
    cover = cool.unionAll(hot).groupBy("key").agg(F.collect_list(F.struct("start", "bits")).alias("runs")).mapInArrow(lambda batches: _intervals(batches, length), "key binary, cover binary")
    out = stage(cover.join(copies, "key", "full").select("key", "cover", F.coalesce("whole", F.lit(False)).alias("whole")), "substring-found")
    release(seeds, places, hot_parts, twice)
    return keyed, out


def substring_dedup(docs: DataFrame, length: int = LENGTH, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and with texts=True the kept words joined by spaces."""
    _, found = repeats(docs, length, seed, text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(F.col(text)).alias("text"), key_of(F.col(text)).alias("key"))
    rows = rows.join(found.hint("merge"), "key", "left").select("doc_id", "text", "cover", "whole")
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * texts

    def keep(batches):
        for batch in batches:
            for first, part in slices(batch.column(1)):
                words, bounds = words_of(part)
                names = np.array(words.dictionary.cast(pa.binary()).to_pylist(), dtype=object)
                codes = np.asarray(words.indices)
                n, removed, digests, kept = np.diff(bounds), np.zeros(len(part), dtype=np.int64), [], []
                for i, (cover, whole) in enumerate(zip(batch.column(2).slice(first, len(part)).to_pylist(), batch.column(3).slice(first, len(part)).to_pylist(), strict=True)):
                    own = codes[bounds[i] : bounds[i + 1]]
                    if whole and n[i] >= length:
                        own = own[:0]
                    elif cover:
                        stays = np.ones(len(own), dtype=bool)
                        for a, b in np.frombuffer(cover, dtype=np.int32).reshape(-1, 2):
                            stays[a:b] = False
                        own = own[stays]
                    removed[i] = n[i] - len(own)
                    left = b" ".join(names[own])
                    digests.append(hashlib.sha256(left).hexdigest())
                    kept.append(left.decode() if texts else None)
                out = [batch.column(0).slice(first, len(part)), pa.array(n), pa.array(removed), pa.array(digests)]
                yield pa.RecordBatch.from_arrays([*out, *([pa.array(kept, pa.string())] if texts else [])], ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept"] if texts else [])])

    return rows.mapInArrow(keep, schema)


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
