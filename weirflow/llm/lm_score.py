"""Language-model scores: the marginal likelihood of a text over all its segmentations into subword pieces.

The pieces and their order come from an existing vocabulary file (sentencepiece). Its scores are ranks of merges, so they
only start the model (a piece of rank r weighs 1 / (r + 10)); ITERATIONS of expectation maximisation over the training
documents' words turn them into probabilities, all segmentations weighted. A word is written with a leading mark as in
the vocabulary, and white space separates words, so a text's probability is the product of its words' and the end's. Each
distinct word's is found once, by a forward recursion in log space; characters outside the vocabulary fall back to bytes.
Words are taken together as long as they have PART_CHARS characters; one of more than LONG_WORD is taken by itself, place
after place, with the pieces of SLICE_CHARS places at a time.

Beside it stands the base model, add-one smoothed word frequencies. Word counts are those of all training documents. The
HOT_WORDS most frequent words are looked up in a broadcast table; occurrences of all others are joined to the word table
by a shuffle, so no word is a hot key.

Defined results: null texts count as empty, and have the end as their only token; repeated rows are each reported (and
counted); without training documents the base model is uniform and the pieces keep their first weights.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNKS, Rolling, add_chunks, emit_chunks, id_text, mixed, slices, stage, text_of, words_of

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
HOT_WORDS = 65_536
ITERATIONS = 2
PART_CHARS, LONG_WORD, SLICE_CHARS = 200_000, 1024, 65_536
MARK = "▁"


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(id_text(doc_id).cast("binary")), F.lit(7)) == 2


class Lattice:
    """Pieces with log probabilities (natural), and the end's."""

    def __init__(self, path: str = VOCABULARY):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        use = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i))]
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): k for k, i in enumerate(use) if model.is_byte(i)}
        names = ["" if model.is_byte(i) else model.id_to_piece(i) for i in use]
        self.longest = max(map(len, names))
        self.hashes = np.zeros(len(names), dtype=np.uint64)
        for size in {len(n) for n in names} - {0}:
            which = [k for k, n in enumerate(names) if len(n) == size]
            chars = np.array([[ord(c) for c in names[k]] for k in which], dtype=np.uint64)
            self.hashes[which] = Rolling(mixed(chars.ravel())).runs(size)[:: size]
        real = np.array([k for k, n in enumerate(names) if n])
        order = real[np.argsort(self.hashes[real])]
        self.sorted, self.order = self.hashes[order], order
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[self.sorted >> np.uint64(44)] = True
        rank = np.empty(len(names))
        rank[np.argsort([-model.get_score(i) for i in use], kind="stable")] = np.arange(len(names))
        self.set_weights(1 / (rank + 10), 0.02 * (1 / (rank + 10)).sum())

    def set_weights(self, weights: np.ndarray, end: float) -> None:
        total = weights.sum() + end
        self.log_p, self.log_end = np.log(weights / total), float(np.log(end / total))

    def _arcs(self, words: pa.Array) -> tuple[np.ndarray, ...]:
        """Words by falling length: their order, lengths, first characters' places, pieces by length and place, and log probabilities."""
        texts = pc.binary_join_element_wise(pa.scalar(MARK), words, "")
        size = np.asarray(pc.utf8_length(texts)).astype(np.int64)
        order = np.argsort(-size, kind="stable")
        size = size[order]
        joined = "".join(texts.take(pa.array(order)).to_pylist())
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        return order, *self._pieces(chars, size)

    def _pieces(self, chars: np.ndarray, size: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """The same for characters of words of those sizes (one word, if none are given), without an order."""
        size = np.array([len(chars)]) if size is None else size
        first = np.cumsum(size) - size
        roll, left = Rolling(mixed(chars)), np.repeat(first + size, size) - np.arange(len(chars))
        ids = np.full((min(self.longest, int(size[0])) + 1, len(chars)), -1, dtype=np.int32)
        for k in range(1, len(ids)):
            runs = roll.runs(k)
            at = np.flatnonzero(self.maybe[runs >> np.uint64(44)] & (left[: len(runs)] >= k))
            place = np.minimum(np.searchsorted(self.sorted, runs[at]), len(self.sorted) - 1)
            good = self.sorted[place] == runs[at]
            ids[k, at[good]] = self.order[place[good]]
        unknown = np.flatnonzero(ids[1] < 0)
        others, which = np.unique(chars[unknown], return_inverse=True)
        ids[1, unknown] = len(self.log_p) + which
        spelt = [[self.bytes[b] for b in chr(int(c)).encode("utf-8", "surrogatepass")] for c in others]
        return size, first, ids, np.concatenate([self.log_p, [self.log_p[s].sum() for s in spelt], [-np.inf]]), spelt

    def _forward(self, size, first, ids, log_p, back: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Log sums of all paths from a word's begin (or to its end) to each place, and where each word's places begin."""
        base = first + np.arange(len(size))
        out = np.full(int(base[-1] + size[-1]) + 1, -np.inf)
        out[base + size if back else base] = 0
        live = np.searchsorted(-size, -np.arange(int(size[0]) + 1), side="right")
        for j in range(1, int(size[0]) + 1):
            n = live[j]
            now = np.full(n, -np.inf)
            for k in range(1, min(j, len(ids) - 1) + 1):
                piece = ids[k, first[:n] + (size[:n] - j if back else j - k)]
                some = np.flatnonzero(piece >= 0)
                from_ = base[:n][some] + (size[:n][some] - j + k if back else j - k)
                now[some] = np.logaddexp(now[some], out[from_] + log_p[piece[some]])
            out[base[:n] + (size[:n] - j if back else j)] = now
        return out, base

    def _long(self, word: str, times: float = 0.0) -> tuple[float, np.ndarray | None]:
        """The log probability of one long word; with times also how often each piece is used in so many occurrences."""
        chars = np.frombuffer((MARK + word).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        n, most = len(chars), self.longest

        def slices_of(starts):
            """Of each place of a slice: log probabilities of the pieces of 1, 2, ... characters that begin there; the pieces; spellings."""
            for a in starts:
                b = min(a + SLICE_CHARS, n)
                _, _, ids, log_p, spelt = self._pieces(chars[a : min(b + most - 1, n)].astype(np.uint64))
                yield a, b, ids[1:, : b - a].T, log_p, spelt

        starts = range(0, n, SLICE_CHARS)
        alpha = np.full(n + most + 1, -np.inf)
        alpha[0] = 0
        for a, b, ids, log_p, _ in slices_of(starts):
            steps = log_p[ids]
            for i in range(a, b):
                to = alpha[i + 1 : i + 1 + steps.shape[1]]
                np.logaddexp(to, alpha[i] + steps[i - a], out=to)
        whole = float(alpha[n])
        if not times:
            return whole, None
        beta = np.full(n + most + 1, -np.inf)
        beta[n] = 0
        used = np.zeros(len(self.log_p))
        for a, b, ids, log_p, spelt in slices_of(reversed(starts)):
            steps, k = log_p[ids], ids.shape[1]
            for i in range(b - 1, a - 1, -1):
                beta[i] = np.logaddexp.reduce(steps[i - a] + beta[i + 1 : i + 1 + k])
            ends = beta[np.arange(a, b)[:, None] + np.arange(1, k + 1)]
            weight = times * np.exp(alpha[a:b, None] + steps + ends - whole)
            some = ids >= 0
            own = np.bincount(ids[some], weights=weight[some], minlength=len(log_p))
            for c, s in enumerate(spelt):
                np.add.at(own, s, own[len(self.log_p) + c])
            used += own[: len(self.log_p)]
        return whole, used

    def likelihoods(self, words: pa.Array) -> np.ndarray:
        """The log probability (natural) of each word over all segmentations."""
        long = np.asarray(pc.utf8_length(words)) > LONG_WORD
        if long.any():
            out = np.empty(len(words))
            out[~long] = self.likelihoods(words.filter(pa.array(~long)))
            out[long] = [self._long(w)[0] for w in words.filter(pa.array(long)).to_pylist()]
            return out
        if not len(words):
            return np.zeros(0)
        order, size, first, ids, log_p, _ = self._arcs(words)
        alpha, base = self._forward(size, first, ids, log_p)
        out = np.empty(len(words))
        out[order] = alpha[base + size]
        return out

    def expected(self, words: pa.Array, counts: np.ndarray) -> np.ndarray:
        """How often each piece is used, over all segmentations of so many occurrences of the words."""
        long = np.asarray(pc.utf8_length(words)) > LONG_WORD
        if long.any():
            one_by_one = (self._long(w, c)[1] for w, c in zip(words.filter(pa.array(long)).to_pylist(), counts[long].tolist(), strict=True))
            return sum(one_by_one, self.expected(words.filter(pa.array(~long)), counts[~long]))
        if not len(words):
            return np.zeros(len(self.log_p))
        order, size, first, ids, log_p, spelt = self._arcs(words)
        alpha, base = self._forward(size, first, ids, log_p)
        beta, _ = self._forward(size, first, ids, log_p, back=True)
        owner = np.repeat(np.arange(len(size)), size)
        node = np.arange(len(owner)) + owner
        whole, times = alpha[base + size][owner], counts[order][owner]
        out = np.zeros(len(log_p))
        for k in range(1, len(ids)):
            at = np.flatnonzero(ids[k] >= 0)
            piece = ids[k, at]
            out += np.bincount(piece, weights=times[at] * np.exp(alpha[node[at]] + log_p[piece] + beta[node[at] + k] - whole[at]), minlength=len(log_p))
        for c, s in enumerate(spelt):
            np.add.at(out, s, out[len(self.log_p) + c])
        return out[: len(self.log_p)]


def _parts(n: int, most: int) -> list[tuple[int, int]]:
    return [(i, min(most, n - i)) for i in range(0, n, most)]


def _word_parts(words: pa.Array) -> list[tuple[int, int]]:
    """Begin and number of words whose characters are PART_CHARS together, or of one longer word."""
    ends, out, start = np.cumsum(np.asarray(pc.utf8_length(words)).astype(np.int64) + 1), [], 0
    while start < len(words):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PART_CHARS, side="right")))
        out.append((start, stop - start))
        start = stop
    return out


def lowered(texts: pa.Array) -> pa.Array:
    return pc.ascii_lower(texts)


def count_words(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(word, c, n): occurrences in training documents and in all. The end stands as the empty word."""

    def count(batches):
        for batch in batches:
            for first, part in slices(batch.column(1)):
                words, bounds = words_of(lowered(part))
                train = ~np.asarray(batch.column(0).slice(first, len(part)), dtype=bool)
                codes, v = np.asarray(words.indices), len(words.dictionary)
                every = np.bincount(codes, minlength=v)
                own = np.bincount(codes[np.repeat(train, np.diff(bounds))], minlength=v)
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([words.dictionary, pa.array([""])]), pa.array(np.append(own, train.sum())), pa.array(np.append(every, len(part)))], ["word", "c", "n"])

    rows = docs.select(held_out(F.col(doc_id)).alias("held"), text_of(F.col(text)).alias("text"))
    return rows.mapInArrow(count, "word string, c bigint, n bigint").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def fit(words: DataFrame, path: str = VOCABULARY, iterations: int = ITERATIONS) -> Lattice:
    """Piece probabilities from all training occurrences of all words. words: (word, c), staged."""
    model = Lattice(path)
    ends = words.where("word = ''").agg(F.coalesce(F.sum("c"), F.lit(0))).head()[0]
    for _ in range(iterations if ends else 0):
        held, size = words.sparkSession.sparkContext.broadcast(model), len(model.log_p)

        def expect(batches, held=held, size=size):
            total = np.zeros(size)
            for batch in batches:
                for i, n in _word_parts(batch.column(0)):
                    total += held.value.expected(batch.column(0).slice(i, n), np.asarray(batch.column(1).slice(i, n)).astype(float))
            yield emit_chunks(total, 4096)

        used = add_chunks(words.where("c > 0 and word <> ''").select("word", "c").mapInArrow(expect, CHUNKS), size, 4096, np.float64)
        # A tenth of an occurrence for each piece: no string gets probability 0.
        model.set_weights(used + 0.1, float(ends))
    return model


def score(docs: DataFrame, path: str = VOCABULARY, hot_words: int = HOT_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of whole texts)."""
    spark = docs.sparkSession
    words = stage(count_words(docs, doc_id, text), "lm-counts")
    known = words.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).head()
    tokens, size = int(known.n), int(known.v)
    model = fit(words, path)
    held = spark.sparkContext.broadcast(model)
    log10 = float(np.log(10))

    def rate(batches):
        for batch in batches:
            for i, n in _word_parts(batch.column(0)):
                part = batch.slice(i, n)
                out = held.value.likelihoods(part.column(0))
                out[np.asarray(pc.equal(part.column(0), ""))] = held.value.log_end
                c = np.asarray(part.column(1)).astype(float)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(np.log10((c + 1) / (tokens + size + 1))), pa.array(out / log10)], ["word", "c", "n", "base", "own"])

    rated = stage(words.mapInArrow(rate, "word string, c bigint, n bigint, base double, own double"), "lm-words")
    # At most hot_words rows reach the driver.
    top = rated.orderBy(F.desc("n"), "word").limit(hot_words).toArrow()
    table = (top["word"].combine_chunks(), *(np.asarray(top[c]) for c in ("c", "base", "own")))
    sums = _sums(docs, spark.sparkContext.broadcast(table), rated, doc_id, text)
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


def _sums(docs: DataFrame, hot, rated: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), text_of(F.col(text)).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def scan(batches):
        top, c, base, own = hot.value
        for batch in batches:
            for first, part in slices(batch.column(3)):
                ends = pa.array(np.full(len(part), ""))
                words, bounds = words_of(lowered(part))
                n, codes = np.diff(bounds), np.asarray(words.indices)
                at = pc.index_in(words.dictionary, value_set=top)
                place = np.asarray(pc.fill_null(at, -1))[codes]
                owner = np.repeat(np.arange(len(part)), n)
                is_hot = place >= 0
                o, p = owner[is_hot], place[is_hot]
                end = pc.index_in(ends, value_set=top)[0].as_py()
                add = lambda values: np.bincount(o, weights=values[p], minlength=len(part)) + (values[end] if end is not None else 0)  # noqa: E731, B023
                ids = batch.column(0).slice(first, len(part))
                # The document's own row; its word is no word, so it meets none and is no hot key.
                mark = pc.binary_join_element_wise(pa.scalar("\n"), pc.cast(ids, pa.string()), "")
                yield pa.RecordBatch.from_arrays([ids, batch.column(1).slice(first, len(part)), batch.column(2).slice(first, len(part)), mark, pa.array(n + 1), pa.array(add((c > 0).astype(float)).astype(np.int64)), pa.array(add(base)), pa.array(add(own))], NAMES)
                code, who = codes[~is_hot], owner[~is_hot]
                if end is None:
                    words = pa.DictionaryArray.from_arrays(pa.array(codes), pa.concat_arrays([words.dictionary, pa.array([""])]))
                    code, who = np.concatenate([code, np.full(len(part), len(words.dictionary) - 1)]), np.concatenate([who, np.arange(len(part))])
                pair, times = np.unique(who.astype(np.int64) * (len(words.dictionary) + 1) + code, return_counts=True)
                who, code = np.divmod(pair, len(words.dictionary) + 1)
                for a, m in _parts(len(who), 100_000):
                    nulls = pa.nulls(m, batch.schema.field(1).type)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(who[a : a + m])), nulls, pa.nulls(m, pa.bool_()), words.dictionary.take(pa.array(code[a : a + m])), pa.array(times[a : a + m]), pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64())], NAMES)

    rows = rows.mapInArrow(scan, f"row bigint, doc_id {kind}, held_out boolean, word string, times bigint, known bigint, base_sum double, own_sum double")
    joined = rows.join(rated.select("word", "c", "base", "own").hint("merge"), "word", "left")
    own_row = F.col("base_sum").isNotNull()
    return joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum(F.when(own_row, F.col("times")).otherwise(0)).alias("n_tokens"),
        F.sum(F.when(own_row, F.col("known")).otherwise(F.when(F.col("c") > 0, F.col("times")).otherwise(0))).alias("n_known"),
        F.sum(F.when(own_row, F.col("base_sum")).otherwise(F.col("times") * F.col("base"))).alias("base_score"),
        F.sum(F.when(own_row, F.col("own_sum")).otherwise(F.col("times") * F.col("own"))).alias("score"),
    )


NAMES = ["row", "doc_id", "held_out", "word", "times", "known", "base_sum", "own_sum"]


def op5_lm_score(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def brute_force(word: str, log_p: Callable[[str], float | None]) -> float:
    """The log of the summed probability of all segmentations, by listing them: for tests."""
    sums = {0: [0.0]}
    for j in range(1, len(word) + 1):
        sums[j] = [s + lp for i in range(j) for s in sums[i] if (lp := log_p(word[i:j])) is not None]
    return float(np.log(np.sum(np.exp(sums[len(word)]))))
