"""Personal data by candidate gradient boosting, in built-in functions.

Generators of high recall propose overlapping spans: whatever looks like an address with an at sign, one with the at sign
spelt out, or a long group of digits. Boosted trees score every candidate for every kind by its format (digits, groups,
separators, checksum) and its context (words before it, neighbouring characters); thresholds calibrated on examples of
other forms select spans. The base rules (kinds as in BASE) hold by themselves: a candidate adds a span where it overlaps
none of the base's.

There are no labelled spans to learn from, so the trees are fitted on TRAIN_TEXTS generated sentences (a fixed seed) that
hold personal data in many forms and what resembles it: dates, prices, versions, order numbers, ISBNs, times. Thresholds are
set where PRECISION of the candidates of a second family of sentences are right, whose formats and phrases the trees have not
seen. The features of these sentences come from the same expressions that the documents go through. Scoring is one SQL expression a kind: no
shuffle, and no Python where documents are.

Defined results: null and empty texts have no spans; repeated rows are each reported.
"""

from __future__ import annotations

import json
import random
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting
from .common import fresh, text_of
from .spans import digest, hits, none

KINDS = ("email", "ip", "card", "phone")
#: Java patterns of the base rules. Possessive quantifiers match as the greedy ones do here (what follows a run is never in its class), in linear time and without recursion.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a rule to be tried.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: They begin where a run of their characters begins, and take whole runs whatever their length, in linear time.
GENERATORS = (
    r"(?:\G|(?<![^\s@<>()\[\]\",;:|]))[^\s@<>()\[\]\",;:|]++@[^\s@<>()\[\]\",;:|]{3,}+",
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++ ?[\[(] ?[Aa][Tt] ?[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(] ?[Dd][Oo][Tt] ?[\])]) ?[A-Za-z0-9-]++)++",
    r"\(?\+?[0-9](?:[-().\x20/]{0,2}[0-9]){6,}+",
)
GENERATOR_NEEDS = (r"@", r"[\[(] ?[Aa][Tt] ?[\])]", NEEDS["card"].replace(r"[\x20-]?", r"[-().\x20/]{0,2}").removesuffix(r"[-().\x20/]{0,2}[0-9]"))
CONTEXT = {"c_mail": "e-?mail|mail|contact|write|reach", "c_ip": "ip|host|server|addr|address|logged|login", "c_card": "card|visa|credit|debit|mastercard|paid", "c_phone": "phone|tel|call|mobile|fax|cell", "c_not": "order|isbn|version|date|build|invoice|part|ref|page|total|id"}
#: What the kind itself demands of a candidate, whatever the trees say.
GATES = {"email": "c.ats + c.spelt > 0", "ip": "c.octets = 1", "card": "c.luhn = 1", "phone": "c.digits between 8 and 15"}
FEATURES = ["length", "digits", "groups", "longest", "plus", "paren", "dots", "dashes", "spaces", "slashes", "ats", "spelt", "luhn", "octets", "before", "after", *CONTEXT]
TRAIN_TEXTS, PRECISION = 3000, 0.995


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, F.try_to_number(c, F.lit("9"))).otherwise(F.try_to_number(c, F.lit("9")) * 2).cast("int"))
    return F.aggregate(each, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _octets(s: Column) -> Column:
    return F.forall(F.split(s, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3) & F.forall(F.split(s, r"\."), lambda p: F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255)


def base_spans(text: Column, kind: str) -> Column:
    """The base matches of one kind that pass its check."""
    found = F.when(F.regexp_like(text, F.lit(NEEDS[kind])), hits(text, BASE[kind])).otherwise(none())
    if kind == "ip":
        return F.filter(found, lambda x: _octets(x["hit"]))
    if kind == "card":
        return F.filter(found, lambda x: F.when(F.length(_digits(x["hit"])).between(16, 19), luhn(_digits(x["hit"]))).otherwise(False))
    if kind == "phone":
        return F.filter(found, lambda x: F.length(_digits(x["hit"])).between(8, 15))
    return found


def candidates(text: Column) -> Column:
    """All generators' spans with their features."""
    found = F.concat(*(F.when(F.regexp_like(text, F.lit(need)), hits(text, g)).otherwise(none()) for g, need in zip(GENERATORS, GENERATOR_NEEDS, strict=True)))

    def features(x: Column) -> Column:
        hit, num = x["hit"], lambda c: c.cast("double")
        count = lambda chars: num(F.length(hit) - F.length(F.translate(hit, chars, "")))
        left = F.lower(F.substring(text, F.greatest(x["start"] - 23, F.lit(1)), F.least(x["start"], F.lit(24))))
        runs = F.filter(F.split(hit, "[^0-9]+"), lambda r: r != "")
        digits = _digits(hit)
        own = {
            "length": num(F.length(hit)), "digits": num(F.length(digits)), "groups": num(F.size(runs)), "longest": num(F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))),
            "plus": count("+"), "paren": count("()"), "dots": count("."), "dashes": count("-"), "spaces": count(" "), "slashes": count("/"), "ats": count("@"), "spelt": num(F.regexp_like(hit, F.lit(r"[\[(] ?[Aa][Tt]"))),
            "luhn": num(F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)), "octets": num(F.regexp_like(hit, F.lit(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")) & _octets(hit)),
            "before": num(F.regexp_like(left, F.lit(r"[\p{L}\p{N}._/-]$"))), "after": num(F.regexp_like(F.substring(text, x["end"] + 1, 1), F.lit(r"[\p{L}\p{N}_/-]"))),
        } | {k: num(F.regexp_like(left, F.lit(rf"\b(?:{words})\b"))) for k, words in CONTEXT.items()}
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), *(own[f].alias(f) for f in FEATURES))

    return F.transform(found, features)


#: Context phrases of the two families of sentences: trees learn from the first, thresholds come from the second.
SAYS = (
    {"email": ["mail", "contact", "write to", "reach me at"], "ip": ["ip", "host", "server", "logged in from"], "card": ["card", "visa", "credit card", "paid with"], "phone": ["phone", "tel", "call", "mobile", "fax:"], "": ["order", "isbn", "version", "date", "build", "invoice", "part", "ref", "page", "total", "id"]},
    {"email": ["e-mail", "send it to my mail", "email me:", "please contact"], "ip": ["ip address", "from host", "addr"], "card": ["mastercard", "debit card no.", "charged the card"], "phone": ["telephone", "cell:", "please call", "phone no."], "": ["order no.", "the invoice", "in version", "on the date", "part number", "see page", "total of", "id number"]},
)


def examples(n: int = TRAIN_TEXTS, seed: int = 11, family: int = 0) -> list[tuple[str, str, int, int]]:
    """(text, kind or none, start, end) of generated sentences. The families differ in formats and in context."""
    r = random.Random(seed + family)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randint(2, 9)))

    def card(good: bool, separators: list[str]) -> str:
        d = [r.choice("3456"), *num(14)]
        total = sum(sum(map(int, str(int(c) * (2 - i % 2)))) for i, c in enumerate(d))
        d.append(str((-total + (0 if good else r.randint(1, 9))) % 10))
        s, sep = "".join(d), r.choice(separators)
        return sep.join(s[i : i + 4] for i in range(0, 16, 4))

    octet = lambda: str(r.randint(0, 255))
    first = {
        "email": lambda: r.choice([f"{word()}.{word()}@{word()}.com", f"{word()} (at) {word()} (dot) org", f"{word()}[at]{word()}.net", f"é{word()}@{word()}.fr"]),
        "ip": lambda: ".".join(octet() for _ in range(4)),
        "card": lambda: card(True, ["", " ", "-", "."]),
        "phone": lambda: r.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"+{r.randint(1, 99)} {num(3)} {num(3)} {num(4)}", f"0{num(2)} {num(4)} {num(4)}", f"+1 ({num(3)}) {num(3)}-{num(4)}"]),
        "": lambda: r.choice([f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02} {num(2)}", f"{num(1)}.{num(2)}.{num(3)}.{num(4)}", f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", num(r.randint(7, 22)), f"{word()}@{word()}", f"{num(3)}.{num(3)}.{num(3)}.{num(3)}", card(False, ["", " ", "-"]), f"{num(4)}-{num(4)}-{num(2)}", f"{num(1)}.{num(8)}", f"{num(2)} {num(2)} {num(2)} {num(2)}"]),
    }
    second = {
        "email": lambda: r.choice([f"{word()}_{word()}{num(2)}@{word()}.{word()}.org", f"{word()}{num(2)} [at] {word()} [dot] com", f"{word()}.{word()} ( at ) {word()} ( dot ) net", f"ü{word()}@{word()}.de"]),
        "ip": lambda: f"10.{octet()}.{octet()}.{octet()}",
        "card": lambda: card(True, ["/", " ", "-", ""]),
        "phone": lambda: r.choice([f"{num(3)}.{num(3)}.{num(4)}", f"({num(3)}){num(3)}-{num(4)}", f"+{r.randint(1, 99)}-{num(2)}-{num(4)}-{num(4)}", f"0{num(3)}-{num(6)}", f"{num(3)} {num(3)} {num(4)}"]),
        "": lambda: r.choice([f"{num(2)}/{num(2)}/{num(4)}", f"{r.randint(1, 28):02}.{r.randint(1, 12):02}.{r.randint(1900, 2030)} {num(2)}", f"@{word()}", f"{num(4)} {num(4)}", f"{word()}@{num(3)}", num(r.randint(7, 30)), card(False, ["", "/"]), f"{num(5)}-{num(3)}-{num(6)}", f"{num(2)}:{num(2)}:{num(2)}.{num(6)}", f"{num(1)},{num(3)},{num(3)}.{num(2)}"]),
    }
    makers, says = ((first, SAYS[0]), (second, SAYS[1]))[family]
    out = []
    for i in range(n):
        kind = ("", "email", "", "ip", "", "card", "", "phone")[i % 8]
        what, told = makers[kind](), kind if r.random() < 0.75 else ""
        # Phones without a plus sign and addresses count as such only where the context says so.
        left = " ".join(word() for _ in range(r.randint(1, 6))) + " " + (r.choice(says[told]) + r.choice([" ", ": "]) if r.random() < 0.85 else "")
        real = kind if kind in ("email", "card") or "+" in what or (told and left.rstrip(": ").endswith(tuple(x.rstrip(":") for x in says[kind]))) else ""
        out.append((left + what + " " + word() + r.choice([".", " ", ""]), real, len(left), len(left) + len(what)))
    return out


def _featured(spark: SparkSession, told: list[tuple[str, str, int, int]]) -> tuple[np.ndarray, list[str]]:
    """The features of all candidates in the sentences, and the kind that each is."""
    source = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps([{"i": i, "t": t} for i, (t, *_) in enumerate(told)])), "array<struct<i:int,t:string>>")).alias("e"))
    rows = source.select("e.i", F.explode(candidates(F.col("e.t"))).alias("c")).collect()
    spot = [told[row.i][1] if (row.c["start"], row.c["end"]) == told[row.i][2:] else "" for row in rows]
    return np.array([[row.c[f] for f in FEATURES] for row in rows]), spot


@cache
def _models(app: str) -> dict[str, tuple[str, float]]:
    """Of each kind: the expression of its log odds, and the threshold. app: fitted once for each Spark application."""
    spark = SparkSession.active()
    (x, spot), (other, other_spot) = (_featured(spark, examples(n, family=family)) for family, n in enumerate((TRAIN_TEXTS, TRAIN_TEXTS // 2)))
    out = {}
    for kind in KINDS:
        base, trees = boosting.fit(x, np.array([float(s == kind) for s in spot]))
        z, t = boosting.predict(base, trees, other), np.array([float(s == kind) for s in other_spot])
        # Calibration: the lowest log odds from which on candidates of the other family are right so often.
        order = np.argsort(-z, kind="stable")
        good = np.cumsum(t[order]) / np.arange(1, len(order) + 1)
        last = np.flatnonzero((good >= PRECISION) & (np.diff(np.append(z[order], -np.inf)) < 0))
        out[kind] = boosting.sql(base, trees, FEATURES, "c"), float(z[order][last[-1]]) if len(last) else float("inf")
    return out


def find(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """docs with a column of all spans, array<struct<ord, start, end, kind, base>>. A column of that name is replaced."""
    models = _models(docs.sparkSession.sparkContext.applicationId)
    docs = docs.drop(out)
    b, c, t = fresh(docs, "_base"), fresh(docs, "_more"), fresh(docs, "_text")
    tag = lambda i, kind, own: lambda x: F.struct(F.lit(i).alias("ord"), x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"), F.lit(own).alias("base"))
    rows = docs.withColumn(t, text_of(F.col(text)))
    rows = rows.withColumn(b, F.concat(*(F.transform(base_spans(F.col(t), k), tag(i, k, True)) for i, k in enumerate(KINDS)))).withColumn(c, candidates(F.col(t)))
    rows = rows.withColumn(c, F.filter(c, lambda x: ~F.exists(F.col(b), lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"]))))
    more = [F.transform(F.expr(f"filter(`{c}`, c -> {GATES[k]} and {odds} >= {least!r}D)" if np.isfinite(least) else f"slice(`{c}`, 1, 0)"), tag(i, k, False)) for i, (k, (odds, least)) in enumerate(models.items())]
    return rows.withColumn(out, F.sort_array(F.concat(b, *more))).drop(b, c, t)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span in the text replaced by its kind in brackets; overlapping spans by the first one's. Null texts stay null."""
    spans, body = fresh(docs, "_pii"), F.col(text)
    found = find(docs, text, spans)
    first = F.array_sort(spans, lambda x, y: F.when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(y["end"] - x["end"]))
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda s, x: F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(x["start"] >= s["at"], F.concat(s["out"], F.substring(body, s["at"] + 1, x["start"] - s["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(s["out"]).alias("out"))
    clean = F.aggregate(first, state, step, lambda s: F.concat(s["out"], F.substring(body, s["at"] + 1, 2**31 - 1)))
    return found.withColumn(text, F.when(F.size(spans) > 0, clean).otherwise(body)).select(*docs.columns)


def op1_pii(spark, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), out="s")
    base = F.filter("s", lambda x: x["base"])
    count = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(digest(base).cast("binary"), 256).alias("base_sha256"), digest(F.col("s")).alias("spans"))
