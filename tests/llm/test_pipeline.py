"""The corpus pipeline, stage by stage against brute force, and the registered queries over whole test tables."""

import hashlib
import json
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from weirflow.llm import common, decontam, entry, mixing, quality, secrets

from .test_operators import DOCS, base_pii, brute_classes, brute_coverage, brute_substring, brute_targets, prose, words

SF = "/root/testdata/sf0.001"
KEY = "AKIA" + "Q7" * 8


def junk(r):
    return " | ".join(prose(r, 30).upper().split()) + " !!!"


def tables(spark, folder, docs, schema=DOCS):
    """documents, labels (of every third document, by what the text looks like) and benchmark as Parquet files."""
    r = random.Random(44)
    items = [prose(r, r.randint(12, 30)) for _ in range(4)]
    df = spark.createDataFrame(docs, schema)
    df.repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(d[0], 0 if "!!!" in (d[1] or "") else 1, 0) for d in docs if d[0] is not None and d[0] % 3 == 0]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return items


def documents():
    r = random.Random(44)
    items = [prose(r, r.randint(12, 30)) for _ in range(4)]
    r = random.Random(45)
    good = [prose(r, r.randint(40, 90)) for _ in range(60)]
    texts = [*good, *(junk(r) for _ in range(60))]
    for t in good[:12]:
        w = t.split()
        w[3] = "edited"
        texts += [t, " ".join(w)]
    texts += [f"{prose(r, 20)} {items[i % 4]} {prose(r, 20)}" for i in range(8)]
    texts += [f"{prose(r, 30)} {KEY} {prose(r, 10)} password: {'Zq' * 8}" for _ in range(6)]
    texts += [None, None, "", "  ", prose(r, 8000)]
    rows = [(i, t, "en", None if i % 13 == 0 else f"s{i % 3}", 7) for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[5], (None, good[20], "en", "s1", 7)]


def masked(text):
    """The text with every span of every rule masked, overlapping ones once, by Python's expressions."""
    if text is None:
        return None
    spans = sorted((m.start(), m.end()) for rule in secrets.BASE_RULES + secrets.MORE_RULES for m in re.finditer(rule.pattern, text, re.A) if len(m.group(rule.group)) >= rule.least)
    out, at = "", 0
    for start, end in spans:
        if start >= at:
            out += text[at:start] + "[SECRET]"
        at = max(at, end)
    return out + text[at:]


def test_stages_against_brute_force(spark, tmp_path):
    docs, folder = documents(), str(tmp_path)
    items = tables(spark, folder, docs)
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    source, read = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, source, folder)
        assert name == "mixing" or out.columns == source.columns
        path = f"{folder}/{name.replace(' ', '-')}"
        out.write.parquet(path)
        read[name] = (rows(source), rows(source := spark.read.parquet(path)), source.columns)
    # Quality: what the trained network scores at the threshold or above; clean documents stay, junk goes.
    before, kept, _ = read["quality classifier"]
    model = quality.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    score = model.scores(pa.array([d[1] for d in before], pa.string()))
    assert kept == [d for d, s in zip(before, score, strict=True) if s >= quality.THRESHOLD]
    assert sum("!!!" in (d[1] or "") for d in kept) <= 3 and sum(d[0] is not None and d[0] < 60 for d in kept) >= 58
    # Near-duplicates: of each class of a comparison of all pairs, the row of the smallest id, once.
    before, kept, _ = read["near-duplicates"]
    ids = {i: d for i, d in enumerate(sorted(set(before), key=lambda d: (d[0] is None, d[0] or 0)))}
    classes = brute_classes({i: d[1] for i, d in ids.items()})
    assert kept == sorted((ids[c] for c in set(classes.values())), key=repr) and len(kept) < len(set(before)) - 20
    # Decontamination: what covers half an item by greedy tiling goes.
    before, kept, _ = read["decontamination"]
    plain = lambda t: re.sub(r"[^\w]+", " ", (t or "").lower()).split()
    shares = lambda t, item: bool({tuple(t[i : i + 5]) for i in range(len(t) - 4)} & {tuple(item[i : i + 5]) for i in range(len(item) - 4)})
    hit = [any(shares(plain(d[1]), plain(i)) and brute_coverage(plain(d[1]), plain(i)) >= decontam.COVERAGE * len(plain(i)) for i in items) for d in before]
    assert kept == [d for d, h in zip(before, hit, strict=True) if not h] and 4 <= sum(hit) <= 8
    # Secrets: every document stays, spans are masked.
    before, kept, _ = read["secret scans"]
    assert kept == sorted(((d[0], masked(d[1]), *d[2:]) for d in before), key=repr) and sum("[SECRET]" in (d[1] or "") for d in kept) >= 5
    # Mixing: targets by resharing, documents by their hashes up to the budget.
    before, kept, columns = read["mixing"]
    got = {d[0]: dict(zip(columns, d, strict=True)) for d in kept}
    size = {d[0]: len(words(d[1])) for d in before}
    names = sorted({d[3] for d in before if d[3] is not None}) + [None] * any(d[3] is None for d in before)
    sizes = {s: sum(size[d[0]] for d in before if d[3] == s) for s in names}
    target = brute_targets(sizes, names)
    for s in names:
        left, quota = 0, math.floor(target[s])
        copies = quota // sizes[s] if sizes[s] else 0
        for d in sorted((d for d in before if d[3] == s), key=lambda d: hashlib.md5(str(d[0]).encode()).hexdigest()[:12]):
            rest = quota - copies * sizes[s] - left
            more = min(size[d[0]], rest) if rest > 0 else 0
            left += size[d[0]]
            want = copies * size[d[0]] + more
            assert (got[d[0]]["taken"] if d[0] in got else 0) == want and (want == 0 or math.isclose(got[d[0]]["target"], target[s]))
    # The whole run gives what its stages give.
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, folder).collect()) == sorted(got)


def test_run_of_nothing_and_of_further_columns(spark, tmp_path):
    tables(spark, str(tmp_path / "none"), [])
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    clash = ("key", "id", "label", "band", "score", "_key", "_id", "_score", "_secrets", "_row", "size", "taken")
    docs = [(*d, *(["mine"] * len(clash))) for d in documents() if d[0] is None or d[0] % 2 == 0]
    tables(spark, str(tmp_path / "more"), docs, DOCS + "".join(f", {c} string" for c in clash))
    out = corpus_pipeline.run(spark, str(tmp_path / "more"))
    assert set(clash) - {"size", "taken"} <= set(out.columns) and out.count() > 20
    assert out.where(" or ".join(f"{c} <> 'mine'" for c in clash if c not in ("size", "taken"))).count() == 0


def test_run_leaves_one_table(spark, tmp_path):
    tables(spark, str(tmp_path / "in"), documents())
    folder = "/" + common.shared_folder(spark).removeprefix("file:").lstrip("/") + "/weirflow"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    corpus_pipeline.run(spark, str(tmp_path / "in")).count()
    assert [p.rsplit("-", 1)[0] for p in set(os.listdir(folder)) - before] == ["pipeline-mixing"]


# --- registered queries over whole tables


@pytest.fixture(scope="module")
def texts(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def sha(spans):
    return hashlib.sha256(",".join(spans).encode()).hexdigest()


def test_op1(spark, texts):
    for r in entry.queries()["op1_pii"](spark, SF).collect():
        want = base_pii(texts[r.doc_id])
        assert r.base_sha256 == sha(want) and set(want) <= set(r.spans.split(","))  | {""}
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s.startswith(k) for s in want) for k in ("email", "ip", "card", "phone")]


def test_op4(spark, texts):
    got = {r.doc_id: r.class_id for r in entry.queries()["op4_near_duplicates"](spark, SF).collect()}
    assert got == brute_classes(texts)


def test_op5(spark, texts):
    own = {i: [*words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")), ""] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    count = Counter(w for i, ws in own.items() if not held[i] for w in ws)
    n, v = sum(count.values()), len(count)
    for r in entry.queries()["op5_lm_score"](spark, SF).collect():
        ws = own[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(count[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)


def test_op7(spark, texts):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in entry.queries()["op7_substring_dedup"](spark, SF).collect()}
    assert got == brute_substring(texts)


def test_op8(spark, texts):
    rules = secrets.BASE_RULES + secrets.MORE_RULES
    for r in entry.queries()["op8_secrets"](spark, SF).collect():
        found = sorted((m.start(), i, rule.kind, m.end()) for i, rule in enumerate(rules) for m in re.finditer(rule.pattern, texts[r.doc_id] or "", re.A) if len(m.group(rule.group)) >= rule.least)
        told = [f"{kind}:{start}:{end}" for start, _, kind, end in found]
        base = [s for s, f in zip(told, found, strict=True) if f[1] < 3]
        assert r.base_sha256 == sha(base) and r.spans == ",".join(told)
        assert [r[f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s.startswith(f"{k}:") for s in base) for k in ("assign", "access", "hex")]


def test_op9(spark, texts):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id): r.matched_words for r in entry.queries()["op9_decontamination"](spark, SF).collect()}
    split = lambda t: re.sub(r"[\W_]+", " ", (t or "").lower()).split()
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    item_words = {k: split(t) for k, t in items.items()}
    item_grams = {k: grams(w) for k, w in item_words.items()}
    want = {}
    for i, t in texts.items():
        w = split(t)
        own = grams(w)
        for k, w2 in item_words.items():
            if own & item_grams[k]:
                # Only words near a shared run can be in a tile: the rest is replaced, so that brute force ends.
                shared = {j + d for j in range(len(w) - 4) if tuple(w[j : j + 5]) in item_grams[k] for d in range(5)}
                near = [x for j, x in enumerate(w) if {j - 1, j, j + 1} & shared]
                marked = [x if j in shared else f"\0{j}" for j, x in enumerate(w)]
                n = brute_coverage([x for j, x in enumerate(marked) if {j - 1, j, j + 1} & shared], w2)
                assert near
                if n >= decontam.COVERAGE * len(w2):
                    want[i, k] = n
    assert got == want and want


def slow_features(texts, vectors_of, slots_of):
    """Mean and deviation of a text's word vectors, word by word, and the logarithm of its length."""
    out = []
    for t in texts:
        v = np.array([vectors_of[s] for s in slots_of(t)], dtype=float).reshape(-1, quality.DIM)
        out.append(np.concatenate([v.mean(axis=0), v.std(axis=0), [np.log1p(len(v))]]) if len(v) else np.zeros(2 * quality.DIM + 1))
    return np.array(out)


def test_op10(spark, texts):
    """Word vectors and features word by word, the network's scores from them, and the folds."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    dims, signs = quality.index_vectors()
    slots_of = lambda t: quality.slots_of(pa.array([t], pa.string()))[0].tolist()
    some = random.Random(3).sample(sorted(texts), 25)
    sums = np.zeros((quality.SLOTS, quality.DIM))
    for i in some:
        s = slots_of(texts[i])
        for a, x in enumerate(s):
            for y in s[max(0, a - quality.WINDOW) : a + quality.WINDOW + 1]:
                np.add.at(sums[x], dims[y], signs[y])
    fast = sum(quality.context_sums(*quality.slots_of(pa.array([texts[i]], pa.string()))) for i in some)
    assert np.array_equal(sums, fast)
    got = {r.doc_id: r for r in entry.queries()["op10_quality"](spark, SF).collect()}
    assert set(got) == set(texts)
    want = model.network.score(slow_features([texts[i] for i in some], model.vectors, slots_of))
    assert np.allclose([got[i].score for i in some], want, atol=1e-5)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3)
    held = [(r.predicted, truth[i]) for i, r in got.items() if r.held_out and truth.get(i) in (0, 1)]
    assert held and np.mean([a == b for a, b in held]) >= 0.8


def test_quality_of_long_and_repeated_texts(spark):
    """A very long text has the features of its words, repeated rows have equal scores."""
    r = random.Random(12)
    rows = [(i, prose(r, 50) if i % 2 else junk(r)) for i in range(80)] + [(500, " ".join(["word other"] * 200_000))] * 3
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)], "doc_id bigint, quality int, toxic int")
    model = quality.train(df, labels)
    long = {x.score for x in quality.score(df, model).where("doc_id = 500").collect()}
    slots_of = lambda t: quality.slots_of(pa.array([t], pa.string()))[0].tolist()
    assert len(long) == 1 and math.isclose(long.pop(), model.network.score(slow_features([rows[-1][1]], model.vectors, slots_of))[0], abs_tol=1e-5)


def test_tables_of_the_pipeline_have_their_sql(spark):
    """Queries without SQL are those that SQL can't express; the others' SQL is a string over the tables alone."""
    assert set(entry.queries()) - set(entry.oracle_sql()) == {"op1_pii", "op4_near_duplicates", "op5_lm_score", "op6_nearest_neighbours", "op7_substring_dedup", "op8_secrets", "op9_decontamination", "op10_quality"}
    assert json.dumps(entry.oracle_sql()) and mixing.ORACLE.strip()
