"""Gradient-boosted trees of depth two: fitted in numpy, applied as SQL expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """Rows go right where the feature is at least the cut."""

    feature: int
    cut: float
    sides: tuple[tuple[int, float, float, float], tuple[int, float, float, float]]


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], penalty: float) -> tuple[float, int, float]:
    total, best = g.sum() ** 2 / (h.sum() + penalty), (0.0, 0, np.inf)
    for f, points in enumerate(cuts):
        for cut in points:
            right = x[:, f] >= cut
            a, b = g[right].sum(), h[right].sum()
            gain = a * a / (b + penalty) + (g.sum() - a) ** 2 / (h.sum() - b + penalty) - total
            if gain > best[0] + 1e-9:
                best = gain, f, float(cut)
    return best


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 16, rate: float = 0.4, penalty: float = 1.0) -> tuple[float, list[Tree]]:
    """Newton steps on the log loss; deterministic. Returns the first log odds and the trees."""
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    score, trees = np.full(len(y), base), []
    cuts = [u[1:] if len(u := np.unique(x[:, f])) <= 16 else np.unique(np.quantile(x[:, f], np.linspace(0.05, 0.95, 12))) for f in range(x.shape[1])]
    leaf = lambda g, h: float(-rate * g.sum() / (h.sum() + penalty))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        gain, f, cut = _split(x, g, h, cuts, penalty)
        if gain <= 0:
            break
        sides = []
        for right in (False, True):
            rows = (x[:, f] >= cut) == right
            _, f2, cut2 = _split(x[rows], g[rows], h[rows], cuts, penalty)
            up = x[rows][:, f2] >= cut2
            sides.append((f2, cut2, leaf(g[rows][~up], h[rows][~up]), leaf(g[rows][up], h[rows][up])))
            score[np.flatnonzero(rows)] += np.where(up, sides[-1][3], sides[-1][2])
        trees.append(Tree(f, cut, tuple(sides)))
    return base, trees


def predict(base: float, trees: list[Tree], x: np.ndarray) -> np.ndarray:
    out = np.full(len(x), base)
    for t in trees:
        (f0, c0, a0, b0), (f1, c1, a1, b1) = t.sides
        out += np.where(x[:, t.feature] >= t.cut, np.where(x[:, f1] >= c1, b1, a1), np.where(x[:, f0] >= c0, b0, a0))
    return out


def sql(base: float, trees: list[Tree], names: list[str], row: str) -> str:
    """The log odds as an expression over the fields of a struct named row."""

    def inner(side: tuple[int, float, float, float]) -> str:
        f, cut, low, high = side
        return f"{low!r}D" if cut == np.inf else f"IF({row}.{names[f]} >= {cut!r}D, {high!r}D, {low!r}D)"

    terms = [f"IF({row}.{names[t.feature]} >= {t.cut!r}D, {inner(t.sides[1])}, {inner(t.sides[0])})" for t in trees]
    return " + ".join([f"({base!r}D)", *terms]).replace("IF(", "if(")
