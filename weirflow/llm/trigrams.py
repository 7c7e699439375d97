"""Boolean trigram queries from regular expressions.

A regular expression is read into Python's syntax tree. Where a part can match few strings only, these are listed and
joined with their neighbours; a part that can match anything ends the list. Every list that is ended so gives a clause:
one of its strings must occur, and with it all of the string's trigrams. Letters are folded to lower case, as in the index.
"""

from __future__ import annotations

import re._constants as C
import re._parser as parser
from itertools import product

#: More strings than these in a list end it: the query gets weaker, never wrong.
MOST_STRINGS = 64
#: A query in disjunctive form with more terms than these keeps its most selective clauses.
MOST_TERMS = 64
#: Of a term's trigrams these many are looked up, the rarest by their letters: each costs a pass over all texts, and a weaker
#: query only adds candidates.
MOST_GRAMS = 2
#: Characters by falling frequency in prose; all others are rarer.
LETTERS = " etaoinsrhldcumfpgwybvkxjqz"


def _grams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _clause(strings: set[str]) -> set[frozenset[str]] | None:
    """Strings of which one must occur, as alternatives of trigrams; None: no demand."""
    out = {_grams(s) for s in strings}
    return None if not out or frozenset() in out else out


def _walk(tree) -> tuple[list[set[frozenset[str]]], set[str] | None]:
    """Clauses that must hold, and the strings that the tree matches exactly, if they are few."""
    clauses: list[set[frozenset[str]]] = []
    now: set[str] | None = {""}

    def end() -> None:
        nonlocal now
        if now and (c := _clause(now)):
            clauses.append(c)
        now = {""}

    whole = True
    for op, arg in tree:
        inner: list[set[frozenset[str]]] = []
        exact: set[str] | None = None
        if op is C.LITERAL:
            exact = {chr(arg).lower()}
        elif op is C.IN:
            chars: set[str] | None = set()
            for kind, x in arg:
                if kind is C.LITERAL:
                    chars.add(chr(x).lower())
                elif kind is C.RANGE and x[1] - x[0] < 8:
                    chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                else:
                    chars = None
                    break
            exact = chars if chars and len(chars) <= 8 else None
        elif op is C.SUBPATTERN:
            inner, exact = _walk(arg[3])
        elif op is C.BRANCH:
            ways = [_walk(x) for x in arg[1]]
            if all(x is not None for _, x in ways):
                exact = set().union(*(x for _, x in ways))
            else:
                demands = [(c or []) + ([k] if x and (k := _clause(x)) else []) for c, x in ways]
                if all(demands):
                    inner = [set().union(*(min(d, key=len) for d in demands))]
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, body = arg
            inner, exact = _walk(body)
            if low == 0:
                inner, exact = [], ({""} | exact if exact is not None and high == 1 else None)
            elif (low, high) != (1, 1):
                strings = exact if exact is not None and len(exact) ** low <= MOST_STRINGS else None
                if strings and (c := _clause({"".join(x) for x in product(strings, repeat=low)})):
                    inner = [*inner, c]
                exact = None if low != high or strings is None else {"".join(x) for x in product(strings, repeat=low)}
        elif op is C.ATOMIC_GROUP:
            inner, exact = _walk(arg)
        elif op in (C.AT, C.ASSERT, C.ASSERT_NOT):
            continue
        clauses += inner
        if exact is None or len(now) * len(exact) > MOST_STRINGS:
            whole = False
            end()
            if exact is not None and len(exact) <= MOST_STRINGS:
                now = set(exact)
        else:
            now = {a + b for a in now for b in exact}
    if whole:
        return clauses, now
    end()
    return clauses, None


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """The alternatives of trigrams of which one must occur whole in every match's folded text; empty: the pattern demands none."""
    clauses, exact = _walk(parser.parse(pattern))
    if exact and (c := _clause(exact)):
        clauses = [*clauses, c]
    terms: set[frozenset[str]] = set()
    for clause in sorted(clauses, key=lambda c: (len(c), -min(map(len, c)))):
        joined = {a | b for a in terms for b in clause} if terms else set(clause)
        if len(joined) <= MOST_TERMS:
            terms = joined
    return sorted((t for t in terms if not any(o < t for o in terms)), key=sorted)


def rarest(query: list[frozenset[str]], most: int = MOST_GRAMS) -> list[frozenset[str]]:
    """The query with the rarest trigrams of each term alone: it holds wherever the whole query does."""
    rank = lambda gram: (-sum(LETTERS.find(c) if c in LETTERS else len(LETTERS) for c in gram), gram)
    thin = {frozenset(sorted(term, key=rank)[:most]) for term in query}
    return sorted((t for t in thin if not any(o < t for o in thin)), key=sorted)
