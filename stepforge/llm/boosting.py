"""Gradient-boosted trees over small integer features, for models that become column expressions.

Fitting sees a table of distinct feature vectors with their weights, which is as small as the
features are coarse; scoring is a SQL expression, so it runs inside Spark's generated code.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field


@dataclass
class Node:
    """A split (rows with feature <= limit go left) or, without a feature, a leaf."""

    value: float = 0.0
    feature: str | None = None
    limit: int = 0
    left: Node | None = None
    right: Node | None = None

    def sql(self) -> str:
        if self.feature is None:
            return repr(round(self.value, 6)) + "D"
        return f"CASE WHEN {self.feature} <= {self.limit} THEN {self.left.sql()} ELSE {self.right.sql()} END"

    def of(self, row: dict) -> float:
        node = self
        while node.feature is not None:
            node = node.left if row[node.feature] <= node.limit else node.right
        return round(node.value, 6)


@dataclass
class Model:
    features: list[str]
    base: float = 0.0
    trees: list[Node] = field(default_factory=list)

    def margin(self, row: dict) -> float:
        return self.base + sum(t.of(row) for t in self.trees)

    def sql(self) -> str:
        """The probability as an expression over the feature columns."""
        total = " + ".join([repr(self.base) + "D", *(t.sql() for t in self.trees)])
        return f"1D / (1D + exp(-({total})))"


def _grow(rows: list[tuple[dict, float, float]], features: list[str], depth: int, shrink: float) -> Node:
    """One regression tree on (row, gradient, hessian) by second-order gain."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    leaf = Node(value=-shrink * g / (h + 1.0))
    if not depth:
        return leaf
    best = (1e-6, None, 0)
    for f in features:
        at: dict[int, list[float]] = {}
        for row, a, b in rows:
            cell = at.setdefault(row[f], [0.0, 0.0])
            cell[0] += a
            cell[1] += b
        gl = hl = 0.0
        for value in sorted(at)[:-1]:
            gl, hl = gl + at[value][0], hl + at[value][1]
            gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
            if gain > best[0]:
                best = (gain, f, value)
    _, f, limit = best
    if f is None:
        return leaf
    low, high = [r for r in rows if r[0][f] <= limit], [r for r in rows if r[0][f] > limit]
    return Node(0.0, f, limit, _grow(low, features, depth - 1, shrink), _grow(high, features, depth - 1, shrink))


def fit(table: list[tuple[dict, int, float]], features: list[str], rounds: int = 30, depth: int = 3, shrink: float = 0.4) -> Model:
    """Logistic boosting on (row, label 0 or 1, weight)."""
    total = sum(w for *_, w in table)
    good = sum(y * w for _, y, w in table)
    share = min(max(good / total, 1e-3), 1 - 1e-3) if total else 0.5
    model = Model(features, round(math.log(share / (1 - share)), 6))
    margins = [model.base] * len(table)
    for _ in range(rounds if 0 < good < total else 0):
        rows = []
        for (row, y, w), m in zip(table, margins):
            p = 1 / (1 + math.exp(-m))
            rows.append((row, w * (p - y), w * p * (1 - p)))
        tree = _grow(rows, features, depth, shrink)
        model.trees.append(tree)
        margins = [m + tree.of(row) for m, (row, *_) in zip(margins, table)]
    return model


def threshold(scored: list[tuple[float, int, float]], precision: float) -> float:
    """The least probability from which on the weighted precision of (margin, label, weight) is at least ``precision`` (2.0: none is)."""
    ranked = sorted(((1 / (1 + math.exp(-m)), y, w) for m, y, w in scored), key=lambda x: -x[0])
    best, good, total = 2.0, 0.0, 0.0
    for i, (p, y, w) in enumerate(ranked):
        good, total = good + y * w, total + w
        if (i + 1 == len(ranked) or ranked[i + 1][0] < p) and good >= precision * total:
            best = p
    return best
