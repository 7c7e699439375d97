"""Secret scans over a trigram inverted index.

Each rule's regular expression gives a Boolean trigram query (trigrams.py). The index holds postings of the trigrams
that the rules ask for: for each trigram and block of documents the keys of the documents that hold it. A rule's query
intersects postings within blocks, and only its candidates are matched against the expression. Rules that demand no
trigram (long hex digits) are matched against every document.

A document's key is a 64-bit hash of its text: copies share one posting, and where two texts share a key both are
matched, so results are exact. Defined results: null and empty texts have no spans; repeated rows are each reported.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, join_checked, stage, text_of
from .spans import digest, hits, none
from .trigrams import rarest, trigram_query


@dataclass(frozen=True)
class Rule:
    """pattern: read alike by Java and Python. A match counts if the group has so many characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE_RULES = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]++", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}+", 0, 16),
)
#: What the base rules don't name: the published prefixes of some services' keys, and private key files.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}+", 0, 15),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}+", 0, 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", 0, 29),
    Rule("pem", r"-----BEGIN [A-Z ]*+PRIVATE KEY-----", 0, 27),
)
#: Documents whose keys stand in one posting list, about.
BLOCK_ROWS = 32_768


def key_of(text: Column) -> Column:
    return F.xxhash64(text_of(text))


def build_index(docs: DataFrame, trigrams: list[str], text: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Postings (block, trigram, keys) of the given folded trigrams. A block's lists hold about block_rows keys at most."""
    blocks = max(1, -(-docs.count() // block_rows))
    folded = docs.select(key_of(F.col(text)).alias("key"), F.lower(text_of(F.col(text))).alias("folded"))
    held = F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(F.col("folded"), t))
    rows = folded.select("key", F.explode(held).alias("trigram"))
    return rows.groupBy(F.pmod("key", F.lit(blocks)).alias("block"), "trigram").agg(F.collect_set("key").alias("keys"))


def candidates(index: DataFrame, rules: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(key, rules): for each document that satisfies a rule's trigram query, the rules."""
    by_block = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "keys"))).alias("lists"))

    def postings(gram: str) -> Column:
        return F.coalesce(F.try_element_at("lists", F.lit(gram)), F.array().cast("array<bigint>"))

    found = []
    for kind, terms in rules.items():
        for term in terms:
            first, *rest = sorted(term)
            keys = postings(first)
            for gram in rest:
                keys = F.array_intersect(keys, postings(gram))
            found.append(F.struct(F.lit(kind).alias("rule"), keys.alias("keys")))
    each = by_block.select(F.inline(F.array(*found))).select("rule", F.explode("keys").alias("key"))
    return each.groupBy("key").agg(F.collect_set("rule").alias("rules"))


def _matches(text: Column, rule: Rule) -> Column:
    found = hits(text, rule.pattern)
    size = (lambda h: F.length(F.regexp_extract(h, rule.pattern, rule.group))) if rule.group else F.length
    return F.filter(found, lambda x: size(x["hit"]) >= rule.least)


def _tagged(i: int, kind: str):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("ord"), F.lit(kind).alias("kind"), s["end"].alias("end"))


def queries_of(rules: tuple[Rule, ...]) -> dict[str, list[frozenset[str]]]:
    """The trigram query of each rule that demands any."""
    return {r.kind: rarest(q) for r in rules if (q := trigram_query(r.pattern))}


def grams_of(rules: tuple[Rule, ...]) -> list[str]:
    """The trigrams that the rules' index must hold."""
    return sorted(set().union(*(t for q in queries_of(rules).values() for t in q)))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, text: str = "text", out: str = "secrets", index: DataFrame | None = None) -> DataFrame:
    """docs with a column of all spans, array<struct<start, ord, kind, end>> by start and then by rule. A column of that name is replaced.

    index: what build_index() gave for these texts and (at least) the trigrams of grams_of(rules), to be used again.
    """
    queries = queries_of(rules)
    docs = docs.drop(out)
    key, marked = fresh(docs, "_key"), fresh(docs, "_rules")
    keyed = docs.withColumn(key, key_of(F.col(text)))
    if queries:
        index = build_index(docs, grams_of(rules), text) if index is None else index
        found = stage(candidates(index, queries), "secret-candidates").withColumnsRenamed({"key": key, "rules": marked})
        keyed = join_checked(keyed, found, [key], "left")
    else:
        keyed = keyed.withColumn(marked, F.array().cast("array<string>"))
    whole, parts = text_of(F.col(text)), []
    for i, rule in enumerate(rules):
        spans = _matches(whole, rule)
        if rule.kind in queries:
            spans = F.when(F.array_contains(marked, rule.kind), spans).otherwise(none())
        parts.append(F.transform(spans, _tagged(i, rule.kind)))
    return keyed.withColumn(out, F.sort_array(F.concat(*parts))).drop(key, marked)


def redact(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, mask: str = "[SECRET]") -> DataFrame:
    """docs with every span's characters in the text replaced by mask (overlapping spans by one). Null texts stay null."""
    spans = fresh(docs, "_secrets")
    found = scan(docs, rules, text, spans)
    body = F.col(text)
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        piece = F.when(x["start"] >= s["at"], F.concat(s["out"], F.substring(body, s["at"] + 1, x["start"] - s["at"]), F.lit(mask))).otherwise(s["out"])
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), piece.alias("out"))

    clean = F.aggregate(F.col(spans), state, step, lambda s: F.concat(s["out"], F.substring(body, s["at"] + 1, 2**31 - 1)))
    return found.withColumn(text, F.when(F.size(spans) > 0, clean).otherwise(body)).select(*docs.columns)


def op8_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), out="s")
    base = F.filter("s", lambda x: x["ord"] < len(BASE_RULES))
    count = lambda kind: F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", *(count(r.kind).alias(f"n_{r.kind}") for r in BASE_RULES), F.sha2(digest(base).cast("binary"), 256).alias("base_sha256"), digest(F.col("s")).alias("spans"))
