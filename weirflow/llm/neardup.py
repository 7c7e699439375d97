"""MinHash near-duplicates: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

A document is its multiset of runs of five words (all its words, if it has fewer). A shingle weighs its count in the
document times the mean IDF of its words. Document frequencies of shingles themselves would let a group of copies lower
the weight of the very text that it shares, so words carry the IDF. It is counted over all documents in DF_SLOTS hashed
counters; words that fewer than one in RARE documents hold are all as rare as that. Words that share a counter add up to
about a fifth of that floor, so weights are the same at every size of the corpus.

Consistent weighted samples (BANDS x ROWS) agree with the probability of the weighted Jaccard similarity. Exact copies
are one key (the MD5 of the text) from there on. Keys that share a band are compared with one pivot of the band, the key
with the most neighbours (of edited copies, as a rule the original), and linked if their weighted similarity reaches the
threshold. Where a pivot's cluster then still holds several classes, members outside the largest one are compared with all
that may reach the threshold for what the pivot shows: what both share of the pivot's shingles and the shingles outside it
that both have bound their similarity from above. So a group of n near copies takes about n comparisons, and no link
between candidates is lost. Classes are connected components.

Defined results: null texts count as empty; texts without words are copies if they are equal; equal texts are always in
one class; class_id is the smallest doc_id of the class (null if it has none); repeated rows are each reported.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNKS, Rolling, add_chunks, emit_chunks, fresh, hashes_of, join_checked, key_of, mixed, release, slices, stage, text_of, tidy, trim, words_of
from .graph import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 10, 3
DF_SLOTS, DF_CHUNK = 1 << 19, 1 << 14
#: Words in fewer than one of so many documents weigh the same.
RARE = 1024
#: A cluster's members, and those outside its largest class, meet in tasks of a 64th of the cluster, within these bounds of rows.
LEAST_ROWS, CLUSTER_ROWS = 128, 4096


def _samples() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1) at 2**16 points, their inverses and logarithms."""
    x = np.linspace(0, 30, 1 << 18)
    g = np.interp((np.arange(1 << 16) + 0.5) / (1 << 16), 1 - (1 + x) * np.exp(-x), x)
    return g.astype(np.float32), (1 / g).astype(np.float32), np.log(g).astype(np.float32)


def frequencies(docs: DataFrame, text: str) -> tuple[int, np.ndarray]:
    """Documents, and the document frequency of each slot of words."""

    def count(batches):
        df = np.zeros(DF_SLOTS + DF_CHUNK, dtype=np.int64)
        for batch in batches:
            df[DF_SLOTS] += batch.num_rows
            for _, part in slices(batch.column(0)):
                words, bounds = words_of(part)
                slot = (hashes_of(words.dictionary) % np.uint64(DF_SLOTS)).astype(np.int64)[np.asarray(words.indices)]
                owner = np.repeat(np.arange(len(part)), np.diff(bounds))
                df[:DF_SLOTS] += np.bincount(np.unique(owner * DF_SLOTS + slot) % DF_SLOTS, minlength=DF_SLOTS)
        yield emit_chunks(df, DF_CHUNK)

    parts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, CHUNKS)
    df = add_chunks(parts, DF_SLOTS + DF_CHUNK, DF_CHUNK, np.int64)
    return int(df[DF_SLOTS]), df[:DF_SLOTS]


def idf_table(docs: DataFrame, text: str = "text") -> np.ndarray:
    n, df = frequencies(docs, text)
    return (np.log((1 + n) / (1 + np.maximum(df, n / RARE))) + 1).astype(np.float32)


def shingles(texts: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of all texts: hashes ascending within each text, weights (count times mean IDF), mean IDFs, and where each text's begin."""
    words, bounds = words_of(texts)
    own = hashes_of(words.dictionary)
    codes = np.asarray(words.indices)
    weight = idf[(own % np.uint64(DF_SLOTS)).astype(np.int64)][codes].astype(np.float64)
    roll, sums, n = Rolling(own[codes]), np.concatenate([[0.0], np.cumsum(weight)]), np.diff(bounds)
    size = np.minimum(n, SHINGLE)
    count = np.where(n > 0, n - size + 1, 0)
    owner = np.repeat(np.arange(len(n)), count)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + bounds[:-1][owner]
    hashes = np.zeros(len(owner), dtype=np.uint64)
    for k in np.unique(size[n > 0]):
        at = size[owner] == k
        hashes[at] = roll.runs(int(k))[start[at]]
    w = (sums[start + size[owner]] - sums[start]) / np.maximum(size[owner], 1)
    order = np.lexsort((hashes, owner))
    owner, hashes, w = owner[order], hashes[order], w[order]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(owner)))
    return hashes[at], w[at] * times, w[at], np.concatenate([[0], np.cumsum(np.bincount(owner[at], minlength=len(n)))])


def band_hashes(hashes: np.ndarray, weights: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of BANDS hashes for each text that has shingles (in order)."""
    gamma, inverse, log_gamma = _TABLES
    full = np.flatnonzero(np.diff(bounds))
    starts, owner = bounds[:-1][full], np.repeat(np.arange(len(full)), np.diff(bounds)[full])
    log_w = np.log(weights).astype(np.float32)
    odd = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
    out = np.zeros((len(full), BANDS), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(BANDS * ROWS):
            # The hashes are mixed already: the upper bits of a product by an odd number are hashes anew.
            z = (hashes * odd[k]).view(np.uint16).reshape(-1, 4)
            i = z[:, 3]
            beta = z[:, 2] * np.float32(2**-16)
            t = np.floor(log_w * inverse[i] + beta)
            a = log_gamma[z[:, 1]] - gamma[i] * (t - beta + 1)
            least = a == np.minimum.reduceat(a, starts)[owner]
            at = np.flatnonzero(least)
            at = at[np.flatnonzero(np.diff(owner[at], prepend=-1))]
            out[:, k // ROWS] = mixed(out[:, k // ROWS] + hashes[at] + t[at].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k))
    return out


_TABLES = _samples()


def signatures(docs: DataFrame, held: Broadcast, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, key, bands): the key is the MD5 of the text; texts without words have no bands. held: the IDF table."""

    def run(batches):
        for batch in batches:
            for first, part in slices(batch.column(2)):
                hashes, weights, _, bounds = shingles(part, held.value)
                bands = np.zeros((len(part), BANDS), dtype=np.int64)
                full = np.diff(bounds) > 0
                if full.any():
                    bands[full] = band_hashes(hashes, weights, bounds).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full * BANDS)]), pa.int32()), pa.array(bands[full].ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(part)), batch.column(1).slice(first, len(part)), lists], ["doc_id", "key", "bands"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), key_of(F.col(text)).alias("key"), text_of(F.col(text)).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, key binary, bands array<bigint>")


def similarities(pairs: DataFrame, texts: DataFrame, held: Broadcast) -> DataFrame:
    """pairs (a, b) of keys with the Jaccard similarity by weight: (a, b, sim)."""
    joined = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches):
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            both = pc.binary_join_element_wise(a, b, "")
            for first, part in slices(both):
                left = shingles(a.slice(first, len(part)), held.value)
                other = b.slice(first, len(part)).dictionary_encode()
                right = shingles(other.dictionary, held.value)
                which, out = np.asarray(other.indices), np.zeros(len(part))
                for i, j in enumerate(which):
                    (ha, wa), (hb, wb) = ((x[0][x[3][k] : x[3][k + 1]], x[1][x[3][k] : x[3][k + 1]]) for x, k in ((left, i), (right, j)))
                    at = np.minimum(np.searchsorted(hb, ha), max(len(hb) - 1, 0))
                    same = hb[at] == ha if len(hb) and len(ha) else np.zeros(len(ha), dtype=bool)
                    common = np.minimum(wa[same], wb[at[same]]).sum()
                    out[i] = common / max(wa.sum() + wb.sum() - common, 1e-12)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(part)), batch.column(1).slice(first, len(part)), pa.array(out)], ["a", "b", "sim"])

    return joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary, sim double")


def classes(docs: DataFrame, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(signed, keyed): doc_id and key of every document; of every key its smallest id, class_id, class_size and whether it is its class's first."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(idf_table(docs, text))
    signed = stage(signatures(docs, held, doc_id, text), "neardup-signed")
    keys = stage(signed.groupBy("key").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"), F.first("bands").alias("bands")), "neardup-keys")
    tidy(spark)
    texts, members = _compared(docs, keys, doc_id, text)
    # Every member of a band with its pivot.
    pairs = members.where("key <> pivot").select(F.col("key").alias("a"), F.col("pivot").alias("b"))
    tested = stage(similarities(pairs, texts, held), "neardup-tested")
    labels = components(tested.where(F.col("sim") >= similarity).select("a", "b"))
    # What the pivots leave open: clusters of a pivot that still hold several classes.
    open_pairs = _left_over(members, labels, texts, held, similarity)
    known = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = similarities(open_pairs.join(known, ["a", "b"], "left_anti"), texts, held).where(F.col("sim") >= similarity).select("a", "b")
    known_a, known_b = (labels.select(F.col("key").alias(c), F.col("label").alias(f"l{c}")) for c in "ab")
    merged = links.join(known_a, "a", "left").join(known_b, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a <> b").distinct()
    over = components(merged)
    old = labels.select("key", F.col("label").alias("was")).unionAll(over.select("key", F.col("key").alias("was")).join(labels.select("key"), "key", "left_anti"))
    final = stage(old.join(over.select(F.col("key").alias("was"), F.col("label").alias("now")), "was", "left").select("key", F.coalesce("now", "was").alias("label")), "neardup-labels")
    release(texts, members, tested, labels, open_pairs, over)
    tidy(spark, held)
    # A table of its own, so that Spark can split a class that holds a third of all keys.
    own = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    facts = stage(final.join(keys.select("key", "id", "n"), "key").groupBy("label").agg(F.min("id").alias("class_id"), F.sum("n").alias("class_size"), F.min(own)["key"].alias("first_key")), "neardup-facts")
    every = keys.select("key", "id", "n").join(final.hint("merge"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    every = every.join(facts.hint("merge"), "label", "left")
    alone = F.col("class_size").isNull()
    keyed = stage(every.select("key", "id", F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", "n").alias("class_size"), (alone | (F.col("key") == F.col("first_key"))).alias("first")), "neardup-classes")
    release(keys, final, facts)
    return signed.select("doc_id", "key"), keyed


def _compared(docs: DataFrame, keys: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(texts, members): the texts of keys that share a band with another, and of each such key the pivots of its bands."""
    each = keys.select("key", "id", F.posexplode("bands").alias("n", "hash")).select("key", "id", F.xxhash64("n", "hash").alias("band"))
    # What is summed up by band is a table of its own: Spark splits skewed keys of joins whose sides are plain exchanges only.
    shared = stage(each.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "neardup-shared")
    rows = stage(each.join(shared.hint("merge"), "band"), "neardup-bands")
    ids = stage(rows.groupBy("key").agg(F.first(F.coalesce(F.col("id").cast("string"), F.lit(""))).alias("id"), F.sum(F.col("n") - 1).alias("degree")), "neardup-compared")
    named = docs.select(key_of(F.col(text)).alias("key"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), text_of(F.col(text)).alias("text"))
    texts = stage(join_checked(named, ids.select("key", "id"), ["key", "id"]).groupBy("key").agg(F.first("text").alias("text")), "neardup-texts")
    ranked = stage(rows.select("band", "key").join(ids.select("key", "degree").hint("merge"), "key"), "neardup-ranked")
    best = stage(ranked.groupBy("band").agg(F.max_by("key", F.struct("degree", "key")).alias("pivot")), "neardup-pivots")
    members = stage(ranked.join(best.hint("merge"), "band").select("key", "pivot").distinct(), "neardup-members")
    release(shared, rows, ids, ranked, best)
    return texts, members


def _open_pairs(rows: dict[str, np.ndarray], residual: tuple[np.ndarray, ...], missing: tuple[np.ndarray, ...], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a visitor and a resident of one cluster, of different labels, that the pivot doesn't exclude.

    Two members share at most what both hold of the pivot's shingles (their masses) and the shingles outside the pivot that
    both have; the latter are found by postings, most of which have one entry. For the pairs that pass so, what one holds
    of the pivot and the other misses comes off as well; for sets the bound is then the similarity itself. So a visitor
    costs one pass over vectors.

    rows: label, rank (of two visitors the one of smaller rank asks), visitor, weight and mass. residual: owner, hash and
    weight of shingles outside the pivot; missing: of each member's missed pivot shingles their places, the weights of one
    occurrence, and where a member's begin.
    """
    label, rank, visitor, total, mass = (rows[c] for c in ("label", "rank", "visitor", "weight", "mass"))
    n = len(label)
    owner, hashes, values = residual
    order = np.argsort(hashes, kind="stable")
    owner, hashes, values = owner[order], hashes[order], values[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = hashes[1:] != hashes[:-1]
    cut = np.flatnonzero(new)
    ends = np.append(cut[1:], len(hashes))
    code = np.repeat(np.arange(len(cut)), ends - cut)
    shared = (ends - cut)[code] > 1
    by_owner = np.flatnonzero(shared)[np.argsort(owner[shared], kind="stable")]
    begins = np.searchsorted(owner[by_owner], np.arange(n + 1))
    place, weight, bounds = missing
    lacks = np.diff(np.concatenate([[0.0], np.cumsum(weight)])[bounds])
    flags = np.zeros(int(place.max(initial=-1)) + 1)
    out = []
    for o in np.flatnonzero(visitor):
        mine = by_owner[begins[o] : begins[o + 1]]
        first, size = cut[code[mine]], (ends - cut)[code[mine]]
        at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
        outside = np.bincount(owner[at], weights=np.repeat(values[mine], size), minlength=n)
        both = np.minimum(mass[o], mass) + outside
        some = np.flatnonzero((both >= (similarity - 1e-6) * (total[o] + total - both)) & ~visitor & (label != label[o]) & (rank > rank[o]))
        if not len(some):
            continue
        own = slice(bounds[o], bounds[o + 1])
        flags[place[own]] = weight[own]
        count = np.diff(bounds)[some]
        theirs = place[np.repeat(bounds[some] - np.cumsum(count) + count, count) + np.arange(count.sum())]
        common = np.bincount(np.repeat(np.arange(len(some)), count), weights=flags[theirs], minlength=len(some))
        flags[place[own]] = 0
        both = np.minimum(mass[o] - lacks[some] + common, mass[some] - lacks[o] + common) + outside[some]
        some = some[both >= (similarity - 1e-6) * (total[o] + total[some] - both)]
        out.append(np.stack([np.full(len(some), o), some]))
    return tuple(np.concatenate(out, axis=1)) if out else (np.zeros(0, dtype=int),) * 2


def _left_over(members: DataFrame, labels: DataFrame, texts: DataFrame, held: Broadcast, similarity: float) -> DataFrame:
    """(a, b): pairs of different classes around one pivot that may reach the similarity.

    A member lives in one of the parts of its cluster, by hash, and members outside the cluster's largest class visit all of
    them, in groups: a part and a group of visitors are a task's work, so memory is bounded at every size of a cluster, and
    a cluster of one class and a few others costs a row a member.
    """
    members = stage(members.join(labels, "key", "left").select("key", "pivot", F.coalesce("label", "key").alias("label")), "neardup-labelled")
    each = members.groupBy("pivot", "label").agg(F.count("*").alias("n"))
    several = each.groupBy("pivot").agg(F.sum("n").alias("all"), F.max(F.struct("n", "label")).alias("most"), F.count("*").alias("classes")).where("classes > 1 and all > 2")
    share = F.least(F.lit(CLUSTER_ROWS), F.greatest(F.lit(LEAST_ROWS), F.col("all") / 64))
    cuts = lambda n: F.ceil(n / share).cast("int")
    several = stage(several.select("pivot", F.col("most.label").alias("main"), cuts(F.col("all")).alias("parts"), cuts(F.col("all") - F.col("most.n")).alias("groups")), "neardup-several")
    rows = members.where("key <> pivot").join(several.hint("merge"), "pivot")
    joined = rows.join(texts, "key").join(texts.select(F.col("key").alias("pivot"), F.col("text").alias("pivot_text")), "pivot")
    joined = joined.select("pivot", "key", "label", (F.col("label") != F.col("main")).alias("other"), "parts", "groups", "text", "pivot_text")
    lists = "hashes array<bigint>, weights array<float>, missing array<int>, missing_weights array<float>"
    schema = f"pivot binary, key binary, label binary, other boolean, parts int, groups int, weight double, mass double, {lists}"
    names = [c.split()[0] for c in schema.split(", ")]

    def residuals(batches):
        for batch in batches:
            both = pc.binary_join_element_wise(batch.column(6), batch.column(7), "")
            for first, part in slices(both):
                rows = batch.slice(first, len(part))
                hashes, weights, _, bounds = shingles(rows.column(6), held.value)
                pivots = rows.column(7).dictionary_encode()
                ph, _, unit, pb = shingles(pivots.dictionary, held.value)
                lack, gone = [], []
                which, keep, sums = np.asarray(pivots.indices), np.zeros(len(hashes), dtype=bool), np.zeros((2, len(part)))
                for i in range(len(part)):
                    own, of = slice(bounds[i], bounds[i + 1]), ph[pb[which[i]] : pb[which[i] + 1]]
                    held_at = np.minimum(np.searchsorted(hashes[own], of), max(own.stop - own.start - 1, 0))
                    lack.append(np.flatnonzero(hashes[own][held_at] != of) if own.stop > own.start else np.arange(len(of)))
                    gone.append(unit[pb[which[i]] + lack[-1]])
                    at = np.minimum(np.searchsorted(of, hashes[own]), max(len(of) - 1, 0))
                    keep[own] = of[at] != hashes[own] if len(of) else True
                    sums[:, i] = weights[own].sum(), weights[own][~keep[own]].sum()
                offsets = pa.array(np.concatenate([[0], np.cumsum(keep)])[bounds], pa.int32())
                lacks = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lack])]), pa.int32())
                made = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (hashes[keep].view(np.int64), weights[keep].astype(np.float32))]
                made += [pa.ListArray.from_arrays(lacks, pa.array(np.concatenate(x).astype(kind))) for x, kind in ((lack, np.int32), (gone, np.float32))]
                yield pa.RecordBatch.from_arrays([*rows.columns[:6], *map(pa.array, sums), *made], names)

    rows = joined.mapInArrow(residuals, schema)
    home = rows.select("*", F.pmod(F.xxhash64("key"), "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), F.lit(False).alias("visitor"))
    away = rows.where("other").select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64(F.lit(1), "key"), "groups").cast("int").alias("group"), F.lit(True).alias("visitor"))
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = home.unionAll(away).drop("parts", "groups").repartition(tasks, "pivot", "part", "group").sortWithinPartitions("pivot", "part", "group")

    def compare(batches):
        def open_pairs(t: pa.Table):
            t = t.combine_chunks()
            label = np.asarray(t["label"].combine_chunks().dictionary_encode().indices)
            visitor, other = (t[c].to_numpy() for c in ("visitor", "other"))
            key = t["key"].combine_chunks()
            # Of two members outside the largest class the one of the smaller key asks; all of the class are asked.
            rank = np.empty(len(key), dtype=np.int64)
            rank[np.asarray(pc.array_sort_indices(key))] = np.arange(len(key))
            same = np.asarray(key.dictionary_encode().indices)
            rank = np.minimum.reduceat(rank[np.argsort(same, kind="stable")], np.flatnonzero(np.diff(np.sort(same), prepend=-1)))[same]
            facts = {"label": label, "rank": np.where(other, rank, len(key)), "visitor": visitor, "weight": np.asarray(t["weight"]), "mass": np.asarray(t["mass"])}
            lists = {c: t[c].combine_chunks() for c in ("hashes", "weights", "missing", "missing_weights")}
            owner = np.repeat(np.arange(len(label)), np.asarray(lists["hashes"].value_lengths()))
            flat = {c: np.asarray(x.flatten()) for c, x in lists.items()}
            begin = np.concatenate([[0], np.cumsum(np.asarray(lists["missing"].value_lengths()))])
            a, b = _open_pairs(facts, (owner, flat["hashes"].view(np.uint64), flat["weights"].astype(float)), (flat["missing"], flat["missing_weights"].astype(float), begin), similarity)
            return pa.RecordBatch.from_arrays([key.take(pa.array(a)), key.take(pa.array(b))], ["a", "b"])

        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            task = list(zip(*(table[c].to_pylist() for c in ("pivot", "part", "group")), strict=True))
            cuts = [0, *(i for i in range(1, len(task)) if task[i] != task[i - 1])]
            for i, j in zip(cuts, cuts[1:], strict=False):
                yield open_pairs(table.slice(i, j - i))
            rest = table.slice(cuts[-1])
            trim()
        if rest is not None and rest.num_rows:
            yield open_pairs(rest)

    found = dealt.mapInArrow(compare, "a binary, b binary")
    out = stage(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "neardup-open")
    release(members, several)
    return out


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, class_id, class_size."""
    signed, keyed = classes(docs, similarity, doc_id, text)
    return signed.join(keyed.select("key", "class_id", "class_size").hint("merge"), "key").select("doc_id", "class_id", "class_size")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each class: the one of the smallest doc_id; of rows that repeat it, any one.

    The rows that go are listed and taken out; of these lists small ones are broadcast, larger ones shuffled with the texts.
    """
    signed, keyed = classes(docs, similarity, doc_id, text)
    text_id = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    stays = keyed.where("first").select("key", text_id(F.col("id")).alias("id"), F.lit(True).alias("stays"))
    each = signed.select("key", text_id(F.col("doc_id")).alias("id")).groupBy("key", "id").agg(F.count("*").alias("n"))
    counted = stage(each.join(stays.hint("merge"), ["key", "id"], "left").where("stays is null or n > 1").select("key", "id", F.coalesce("stays", F.lit(False)).alias("stays")), "neardup-listed")
    release(signed, keyed)
    tidy(docs.sparkSession)
    key, own = fresh(docs, "_key"), fresh(docs, "_id")
    rows = docs.withColumn(key, key_of(F.col(text))).withColumn(own, text_id(F.col(doc_id)))
    listed = lambda df: df.select(F.col("key").alias(key), F.col("id").alias(own))
    once = join_checked(rows, listed(counted), [key, own], "left_anti").select(*docs.columns)
    again = counted.where("stays")
    if not again.limit(1).count():
        return once
    whole = fresh(docs, "_row")
    again = join_checked(rows, listed(again), [key, own]).groupBy(key, own).agg(F.first(F.struct(*docs.columns)).alias(whole)).select(f"{whole}.*")
    return once.unionAll(again)


def op4_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
