"""Gradient boosted trees of depth two, fitted on the driver and applied as Column expressions.

Fitting takes a small labelled sample in memory (its size is a documented
parameter of the caller); applying is plain arithmetic over feature columns, so
that whole tables are scored by generated code without any Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tree:
    """Root split, a split of each side, and four leaf values (left-left to right-right)."""

    splits: tuple[tuple[int, float], tuple[int, float], tuple[int, float]]
    leaves: tuple[float, float, float, float]


def _best_split(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, ridge: float) -> tuple[float, int, float]:
    best = (0.0, 0, np.inf)
    g, h = grad.sum(), hess.sum()
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, gl, hl = x[order, f], np.cumsum(grad[order]), np.cumsum(hess[order])
        at = np.flatnonzero(v[:-1] < v[1:])
        if len(at):
            gain = gl[at] ** 2 / (hl[at] + ridge) + (g - gl[at]) ** 2 / (h - hl[at] + ridge) - g**2 / (h + ridge)
            k = int(np.argmax(gain))
            if gain[k] > best[0] + 1e-12:
                best = (float(gain[k]), f, float((v[at[k]] + v[at[k] + 1]) / 2))
    return best


class BoostedTrees:
    """Binary classifier with logistic loss; deterministic for given rows."""

    def __init__(self, rounds: int = 30, rate: float = 0.3, ridge: float = 1.0):
        self.rounds, self.rate, self.ridge = rounds, rate, ridge
        self.trees: list[Tree] = []
        self.start, self.threshold = 0.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.start)
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-score))
            grad, hess = y - prob, prob * (1 - prob)
            _, f, t = _best_split(x, grad, hess, self.ridge)
            sides = [x[:, f] <= t, x[:, f] > t]
            splits, leaves = [(f, t)], []
            for side in sides:
                _, f2, t2 = _best_split(x[side], grad[side], hess[side], self.ridge) if side.any() else (0.0, 0, np.inf)
                splits.append((f2, t2))
                for part in (side & (x[:, f2] <= t2), side & (x[:, f2] > t2)):
                    leaf = self.rate * grad[part].sum() / (hess[part].sum() + self.ridge)
                    leaves.append(round(float(leaf), 9))
                    score[part] += leaves[-1]
            self.trees.append(Tree(tuple(splits), tuple(leaves)))
        return self

    def calibrate(self, x: np.ndarray, y: np.ndarray, precision: float) -> BoostedTrees:
        """Sets the least score at which held-out rows at or above it reach the precision."""
        score = self.score(x)
        order = np.argsort(-score, kind="stable")
        reached = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
        ends = np.r_[score[order][:-1] > score[order][1:], True]  # not within a run of equal scores
        good = np.flatnonzero((reached >= precision) & ends)
        self.threshold = float(score[order][good[-1]]) - 1e-6 if len(good) else np.inf
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for t in self.trees:
            (f, c), (fl, cl), (fr, cr) = t.splits
            left = x[:, f] <= c
            low = np.where(left, x[:, fl] <= cl, x[:, fr] <= cr)
            out += np.select([left & low, left, low], t.leaves[:3], t.leaves[3])
        return out

    def column(self, features: list[Column]) -> Column:
        """The score over feature columns in the order of the fitted matrix."""
        total = F.lit(self.start)
        for t in self.trees:
            (f, c), (fl, cl), (fr, cr) = t.splits
            side = lambda g, d, a, b: F.lit(a) if np.isinf(d) else F.when(features[g] <= d, a).otherwise(b)
            total = total + F.when(features[f] <= c, side(fl, cl, *t.leaves[:2])).otherwise(side(fr, cr, *t.leaves[2:]))
        return total
