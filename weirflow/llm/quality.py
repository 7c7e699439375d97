"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer numpy network.

Words (runs of letters and digits) and runs of other signs are hashed to SLOTS slots. A slot's index vector has a few
fixed random signs; its word vector is the sum of the index vectors of all words within WINDOW words of its occurrences
in all documents. Tasks add up integers, so the sums don't depend on the order, and the table has SLOTS x DIM numbers at
every size of the corpus. A document's features are the mean and the deviation of its words' vectors and its length.

The network learns from at most TRAIN_ROWS labelled documents, those with the smallest hashes of their ids; a fifth of
them is left out of the learning and sets the temperature that calibrates the probabilities.

Defined results: null and empty texts have the features of no words and get the network's score for them; without labels
of both classes every score is the share of label 1 (0.5 without labels); null doc_ids count as the empty text in folds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, hashes_of, id_text, mixed, slices, stage, words_of

SLOTS, DIM, SIGNS, WINDOW = 16_384, 48, 2, 2
TRAIN_ROWS = 20_000
HIDDEN, EPOCHS, RATE, DECAY = 32, 60, 3e-3, 1e-4
THRESHOLD = 0.3


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(id_text(doc_id).cast("binary")), F.lit(5))


def slots_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each word's slot, and where each text's words begin."""
    apart = pc.replace_substring_regex(pc.fill_null(texts, ""), r"([^\pL\pN\s]+)", r" \1 ")
    words, bounds = words_of(apart)
    return (hashes_of(words.dictionary) % np.uint64(SLOTS)).astype(np.int64)[np.asarray(words.indices)], bounds


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Of each slot: SIGNS dimensions and their signs."""
    x = mixed(np.arange(1, SLOTS * SIGNS + 1, dtype=np.uint64)).reshape(SLOTS, SIGNS)
    return (x % np.uint64(DIM)).astype(np.int64), np.where(x >> np.uint64(63), 1.0, -1.0)


def context_sums(slots: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """SLOTS x DIM sums of the index vectors around each word, itself included."""
    dims, signs = index_vectors()
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    out = np.zeros(SLOTS * DIM)
    for off in range(WINDOW + 1):
        n = len(slots) - off
        if n <= 0:
            break
        same = owner[:n] == owner[off:]
        left, right = slots[:n][same], slots[off:][same]
        for a, b in ((left, right), (right, left))[: 1 + (off > 0)]:
            for k in range(SIGNS):
                out += np.bincount(a * DIM + dims[b, k], weights=signs[b, k], minlength=SLOTS * DIM)
    return out.reshape(SLOTS, DIM)


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """SLOTS x DIM unit vectors from all documents."""

    def count(batches):
        total = np.zeros((SLOTS, DIM))
        for batch in batches:
            for _, part in slices(batch.column(0)):
                total += context_sums(*slots_of(part))
        used = np.flatnonzero(total.any(axis=1))
        for i in range(0, len(used), 4096):
            rows = used[i : i + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(rows), *(pa.array(total[rows, d].astype(np.int64)) for d in range(DIM))], ["slot", *(f"d{d}" for d in range(DIM))])

    parts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "slot long, " + ", ".join(f"d{d} long" for d in range(DIM)))
    # At most SLOTS rows reach the driver.
    rows = parts.groupBy("slot").agg(*(F.sum(f"d{d}").alias(f"d{d}") for d in range(DIM))).toArrow()
    out = np.zeros((SLOTS, DIM), dtype=np.float64)
    if rows.num_rows:
        out[np.asarray(rows["slot"])] = np.stack([np.asarray(rows[f"d{d}"]) for d in range(DIM)], axis=1)
    out -= out.sum(axis=0) / max(np.abs(out).sum(), 1.0) * np.abs(out).sum(axis=1, keepdims=True)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Features of each text: mean and deviation of its words' vectors, and the logarithm of its length."""
    out = np.zeros((len(texts), 2 * DIM + 1))
    for first, part in slices(texts):
        slots, bounds = slots_of(part)
        sums = np.zeros((len(part), 2 * DIM))
        for a in range(0, len(slots), 65_536):
            got = vectors[slots[a : a + 65_536]]
            rows = np.searchsorted(bounds, np.arange(a, a + len(got)), side="right") - 1
            cuts = np.flatnonzero(np.diff(rows, prepend=-1))
            sums[rows[cuts], :DIM] += np.add.reduceat(got, cuts, axis=0)
            sums[rows[cuts], DIM:] += np.add.reduceat(got * got, cuts, axis=0)
        n = np.maximum(np.diff(bounds), 1)[:, None]
        mean = sums[:, :DIM] / n
        out[first : first + len(part)] = np.hstack([mean, np.sqrt(np.maximum(sums[:, DIM:] / n - mean * mean, 0)), np.log1p(np.diff(bounds))[:, None]])
    return out


@dataclass
class Network:
    center: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.center) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -500, 500)))


def learn(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Network:
    """Adam on the log loss; every fifth row is held out and sets the temperature."""
    if not len(y) or y.min() == y.max():
        share = y.mean() if len(y) else 0.5
        return Network(np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros(1), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    rng, aside = np.random.default_rng(seed), np.arange(len(y)) % 5 == 4
    if len(np.unique(y[~aside])) < 2:
        aside[:] = False
    a, b = x[~aside], y[~aside]
    net = Network(a.mean(axis=0), a.std(axis=0) + 1e-6, rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), 0.0)
    a = (a - net.center) / net.scale
    weights = [net.w1, net.b1, net.w2, np.array([net.b2])]
    m, v, t = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(b))
        for k in range(0, len(b), 128):
            i = order[k : k + 128]
            h = np.tanh(a[i] @ weights[0] + weights[1])
            d = (1 / (1 + np.exp(-np.clip(h @ weights[2] + weights[3][0], -500, 500))) - b[i]) / len(i)
            back = np.outer(d, weights[2]) * (1 - h * h)
            grads = [a[i].T @ back + DECAY * weights[0], back.sum(axis=0), h.T @ d + DECAY * weights[2], np.array([d.sum()])]
            t += 1
            for w, g, mm, vv in zip(weights, grads, m, v, strict=True):
                mm += 0.1 * (g - mm)
                vv += 0.001 * (g * g - vv)
                w -= RATE * (mm / (1 - 0.9**t)) / (np.sqrt(vv / (1 - 0.999**t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = weights[0], weights[1], weights[2], float(weights[3][0])
    if aside.any():
        z, target = net.logit(x[aside]), y[aside]
        steps = np.exp(np.linspace(np.log(0.25), np.log(8), 121))
        loss = [np.mean(np.logaddexp(0, z / s) - target * z / s) for s in steps]
        net.temperature = float(steps[int(np.argmin(loss))])
    return net


@dataclass
class Classifier:
    vectors: np.ndarray
    network: Network

    def scores(self, texts: pa.Array) -> np.ndarray:
        return self.network.score(pooled(texts, self.vectors))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> Classifier:
    """Word vectors from all docs, the network from the rows (at most) labelled documents outside the held-out fold."""
    vectors = word_vectors(docs, text)
    wanted = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & (fold(F.col(doc_id)) != 0)).select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y"))
    sample = stage(wanted.orderBy(F.xxhash64("id"), "id", "y").limit(rows), "quality-sample")
    held = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches):
        for batch in batches:
            x = pooled(batch.column(2), held.value).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))], ["id", "y", "x"])

    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("t")).join(F.broadcast(sample), "id").select(F.col("id").cast("string"), "y", "t")
    got = texts.mapInArrow(features, "id string, y int, x array<float>").orderBy(F.xxhash64("id"), "id", "y", F.xxhash64("x")).limit(rows).toArrow()
    x = np.asarray(got["x"].combine_chunks().flatten() if got.num_rows else [], dtype=np.float64).reshape(got.num_rows, 2 * DIM + 1)
    return Classifier(vectors, learn(x, np.asarray(got["y"], dtype=np.float64)))


def score(docs: DataFrame, model: Classifier, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the probability of label 1 in a last column; a column of that name is replaced."""
    docs = docs.drop(out)
    held, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches):
        for batch in batches:
            texts = batch.column(place)
            s = held.value.scores(texts if pa.types.is_string(texts.type) else texts.cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], [*batch.schema.names, out])

    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{out}` double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs whose score reaches the threshold; the columns of docs."""
    out = fresh(docs, "_score")
    return score(docs, train(docs, labels), out=out).where(F.col(out) >= threshold).select(*docs.columns)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs.select("doc_id", "text"), train(docs, labels)).drop("text")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
