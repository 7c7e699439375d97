"""Where regular expressions match, with built-in functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HIT = "array<struct<start:int,end:int,hit:string>>"


def none() -> Column:
    return F.array().cast(HIT)


def hits(text: Column, pattern: str) -> Column:
    """The leftmost non-overlapping matches of a Java pattern that never matches the empty text: start and end in code points, and the text.

    What split() leaves between matches and what regexp_extract_all() finds alternate, so lengths give the places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found, lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit")))
    start = F.struct(F.lit(0).alias("at"), none().alias("out"))

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + pair["gap"]
        end = begin + F.length(pair["hit"])
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), pair["hit"].alias("hit")))).alias("out"))

    return F.aggregate(pairs, start, step, lambda state: state["out"])


def digest(spans: Column) -> Column:
    """kind:start:end of an array of structs, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
