"""Small boosted trees over integer features: fitted to counts of distinct feature rows, applied as a column expression.

Trees are symmetric: all nodes of a level ask the same question, so that a leaf is a number made of the answers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TREES, DEPTH = 40, 3
RATE, PENALTY = 0.3, 1.0


@dataclass(frozen=True)
class Trees:
    """``features`` and ``limits`` of each tree's levels, ``leaves`` of each tree, and what every score starts from."""

    features: list[int]
    limits: list[int]
    leaves: list[float]
    start: float
    depth: int = DEPTH

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Log-odds of feature rows (on the driver; :func:`score` is the same as a column)."""
        out = np.full(len(rows), self.start)
        weights = 1 << np.arange(self.depth)
        for t in range(len(self.leaves) >> self.depth):
            levels = slice(t * self.depth, (t + 1) * self.depth)
            leaf = (rows[:, self.features[levels]] > np.array(self.limits[levels])) @ weights
            out += np.array(self.leaves)[(t << self.depth) + leaf]
        return out


def fit_trees(rows: np.ndarray, positive: np.ndarray, negative: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Gradient boosting of the logistic loss; ``positive`` and ``negative`` are how often each feature row was seen so."""
    n = (positive + negative).astype(float)
    start = float(np.log((positive.sum() + 1) / (negative.sum() + 1)))
    cuts = [(f, int(v)) for f in range(rows.shape[1]) for v in np.unique(rows[:, f])[:-1]] if len(rows) else []
    above = np.array([rows[:, f] > v for f, v in cuts]) if cuts else np.zeros((0, len(rows)), bool)
    features, limits, leaves = [], [], []
    score = np.full(len(rows), start)
    for _ in range(trees if cuts else 0):
        chance = 1 / (1 + np.exp(-score))
        gradient, curve = positive - n * chance, n * chance * (1 - chance)
        leaf = np.zeros(len(rows), np.int64)
        for level in range(depth):
            parts = 1 << level
            best, chosen = -1.0, 0
            for c in range(len(cuts)):
                g, h = (np.bincount(leaf + parts * above[c], w, 2 * parts) for w in (gradient, curve))
                gain = float((g * g / (h + PENALTY)).sum())
                if gain > best + 1e-9:
                    best, chosen = gain, c
            leaf += parts * above[chosen]
            features.append(cuts[chosen][0]), limits.append(cuts[chosen][1])
        g, h = (np.bincount(leaf, w, 1 << depth) for w in (gradient, curve))
        values = RATE * g / (h + PENALTY)
        leaves.extend(values.tolist())
        score = score + values[leaf]
    return Trees(features, limits, leaves, start, depth)


def _literal(values: list, kind: str) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def score(model: Trees, features: Column) -> Column:
    """Log-odds of an array of integer features."""
    trees = len(model.leaves) >> model.depth
    if not trees:
        return F.lit(model.start)
    names, limits, leaves = _literal(model.features, "int"), _literal(model.limits, "int"), _literal([repr(x) for x in model.leaves], "double")

    def leaf(t: Column) -> Column:
        out = F.shiftleft(t, model.depth)
        for level in range(model.depth):
            at = t * model.depth + level
            out = out + F.when(F.get(features, F.get(names, at)) > F.get(limits, at), 1 << level).otherwise(0)
        return out

    return F.aggregate(F.sequence(F.lit(0), F.lit(trees - 1)), F.lit(model.start), lambda s, t: s + F.get(leaves, leaf(t)))


def least_scores(kinds: np.ndarray, scores: np.ndarray, positive: np.ndarray, negative: np.ndarray, n_kinds: int, precision: float) -> list[float]:
    """For each kind the lowest score from which on held-out rows are right with ``precision``; infinite if there is none.

    One wrong row is added to those seen, so that a few lucky rows do not open a threshold.
    """
    out = []
    for k in range(n_kinds):
        mine = np.flatnonzero(kinds == k)
        order = mine[np.argsort(-scores[mine], kind="stable")]
        right, wrong = np.cumsum(positive[order]), np.cumsum(negative[order])
        last = np.append(scores[order][1:] < scores[order][:-1], True) if len(order) else np.zeros(0, bool)  # equal scores go together
        fine = np.flatnonzero(last & (right >= precision * (right + wrong + 1)))
        out.append(float(scores[order][fine[-1]]) if len(fine) else float("inf"))
    return out
