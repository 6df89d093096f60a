"""Gradient-boosted trees for two classes and isotonic calibration, for training sets that fit the driver.

Callers bound the training rows and say by how much. Trees are small, so a model is a few hundred numbers: it is scored
in Python by arrays, or as a Spark expression.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Node:
    """An inner node sends rows with ``feature <= cut`` to ``low``; a leaf has ``value`` alone."""

    value: float = 0.0
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None


@dataclass
class Trees:
    start: float = 0.0
    trees: list[Node] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for tree in self.trees:
            todo = [(tree, np.arange(len(x)))]
            while todo:
                node, rows = todo.pop()
                if node.feature < 0:
                    total[rows] += node.value
                elif len(rows):
                    left = x[rows, node.feature] <= node.cut
                    todo += [(node.low, rows[left]), (node.high, rows[~left])]
        return total

    def margin_column(self, feature: Callable[[int], Column]) -> Column:
        """The margin as a Spark expression; ``feature`` gives the column of a feature by its place."""

        def walk(node: Node) -> Column:
            if node.feature < 0:
                return F.lit(node.value)
            return F.when(feature(node.feature) <= F.lit(node.cut), walk(node.low)).otherwise(walk(node.high))

        total = F.lit(self.start)
        for tree in self.trees:
            total = total + walk(tree)
        return total


def sigmoid(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: float = 5.0, ridge: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss over features cut into ``bins``; no randomness. One class: a constant."""
    n = len(y)
    share = (y.sum() + 0.5) / (n + 1.0)
    model = Trees(start=float(np.log(share / (1 - share))))
    if n == 0 or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    coded = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    margin = np.full(n, model.start)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int) -> Node:
        gs, hs = g[rows].sum(), h[rows].sum()
        node, best = Node(value=float(-rate * gs / (hs + ridge))), 1e-6
        if left == 0 or len(rows) < 2 * least:
            return node
        for j, e in enumerate(edges):
            code = coded[rows, j]
            gl = np.cumsum(np.bincount(code, g[rows], len(e) + 1))[:-1]
            hl = np.cumsum(np.bincount(code, h[rows], len(e) + 1))[:-1]
            nl = np.cumsum(np.bincount(code, minlength=len(e) + 1))[:-1]
            gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
            gain[(nl < least) | (len(rows) - nl < least)] = -1
            if len(gain) and gain.max() > best:
                k = int(gain.argmax())
                best, node.feature, node.cut = gain[k], j, float(e[k])
        if node.feature >= 0:
            goes = x[rows, node.feature] <= node.cut
            node.low, node.high = grow(rows[goes], g, h, left - 1), grow(rows[~goes], g, h, left - 1)
        return node

    for _ in range(rounds):
        p = sigmoid(margin)
        tree = grow(np.arange(n), p - y, p * (1 - p), depth)
        margin += Trees(0.0, [tree]).margin(x)
        model.trees.append(tree)
    return model


@dataclass
class Isotonic:
    """A rising step-free map of margins to probabilities, linear between the blocks' centres."""

    at: np.ndarray
    value: np.ndarray

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return np.interp(margin, self.at, self.value)

    def column(self, margin: Column) -> Column:
        """The same as a Spark expression."""
        out = F.lit(float(self.value[-1]))
        for k in range(len(self.at) - 1, 0, -1):
            (a, b), (u, v) = self.at[k - 1 : k + 1].tolist(), self.value[k - 1 : k + 1].tolist()
            out = F.when(margin < b, u + (margin - a) * ((v - u) / (b - a) if b > a else 0.0)).otherwise(out)
        return F.when(margin <= float(self.at[0]), float(self.value[0])).otherwise(out)


def isotonic(margin: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators, each block counting half a row of either class more so that no value is 0 or 1."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum of margins, rows, positives
    for m, label in zip(margin[order].tolist(), y[order].tolist()):
        blocks.append([m, 1.0, float(label)])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    if not blocks:
        return Isotonic(np.array([0.0]), np.array([0.5]))
    at = np.array([s / n for s, n, _ in blocks])
    value = np.array([(k + 0.5) / (n + 1) for _, n, k in blocks])
    return Isotonic(at, np.maximum.accumulate(value))
