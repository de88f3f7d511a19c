"""Least squares with factors of many levels.

The design of a factor is a table of zeros with one 1 a row, so its cross-products are counts and sums by
pairs of levels: one group-by to the cells of all factors, then one of the cells for each pair of terms.
The largest factor of a model is absorbed: its block is diagonal, so Spark eliminates it level by level, by
joins on the level, and only the other terms' columns make up a dense system on the driver.
"""

from __future__ import annotations

from functools import cache, reduce
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import as_list
from .storage import staged

#: Cells of the dense part: the square of the columns of all terms but the absorbed factor.
DENSE = 50_000_000


class _Term:
    """A product of factors and numbers: a column for each combination of levels that occurs."""

    def __init__(self, name: str, kinds: dict[str, str]):
        self.name, parts = name, name.split("*") if name else []
        self.factors = sorted(p for p in parts if kinds[p] == "string")
        self.numbers = [p for p in parts if kinds[p] != "string"]
        self.index: dict[tuple, int] | None = None

    def value(self) -> Column:
        return reduce(lambda a, b: a * b, [F.col(x).cast("double") for x in self.numbers], F.lit(1.0))


class CrossProducts:
    """Sums of products of all columns of the terms and of ``y``, by levels, over the complete rows of ``df``."""

    def __init__(self, df: DataFrame, y: str, terms: list[str]):
        kinds = dict(df.dtypes)
        self.terms = [_Term(t, kinds) for t in terms]
        names = list(dict.fromkeys([*[p for t in self.terms for p in [*t.factors, *t.numbers]], y]))
        rows = df.select(*names).na.drop()
        plain = [t for t in self.terms if not t.factors]
        means = rows.agg(F.count(F.lit(1)), F.avg(F.col(y).cast("double")), *[F.avg(t.value()) for t in plain]).first()
        self.n = means[0]
        # numbers without a factor, and y, are centred: the intercept's span is in every model
        values = [t.value() - F.lit(means[2 + plain.index(t)] or 0.0) if t in plain else t.value() for t in self.terms] + [F.col(y).cast("double") - F.lit(means[1] or 0.0)]
        factors = sorted({f for t in self.terms for f in t.factors})
        pairs = list(combinations_with_replacement(range(len(values)), 2))
        self.cells = staged(
            rows.groupBy(*factors).agg(
                F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(v).alias(f"s{i}") for i, v in enumerate(values)],
                *[F.sum(values[i] * values[j]).alias(f"p{i}_{j}") for i, j in pairs]
            ),
            "cells"
        )
        self.y = len(self.terms)
        held = {tuple(t.factors): F.count_distinct(*t.factors) for t in self.terms if t.factors}
        self.sizes = dict(zip(held, self.cells.agg(*held.values()).first())) if held else {}

    def _by(self, factors: list[str], what: str) -> list[tuple[tuple, float]]:
        """One row for each combination of levels: as many as the cross-product has cells that are not zero."""
        return [(tuple(r[:-1]), r[-1] or 0.0) for r in self.cells.groupBy(*factors).agg(F.sum(what)).collect()]

    def factors(self, i: int) -> list[str]:
        return [] if i == self.y else self.terms[i].factors

    def size(self, i: int) -> int:
        return self.sizes.get(tuple(self.factors(i)), 1)

    def index(self, i: int) -> dict[tuple, int]:
        """Columns of a term of the dense part by their levels; never asked for the absorbed factor."""
        t = self.terms[i]
        if t.index is None:
            t.index = {k: j for j, k in enumerate(sorted(k for k, _ in self._by(t.factors, f"p{i}_{i}")))}
        return t.index

    def block(self, i: int, j: int) -> np.ndarray:
        """Cross-product of the columns of terms i and j (``self.y`` is y)."""
        if i > j:
            return self.block(j, i).T
        a, b = ([], []) if j == self.y else (self.terms[j].factors, [self.index(j)])
        own = self.factors(i)
        both = sorted({*own, *a})
        at = {f: k for k, f in enumerate(both)}
        out = np.zeros((self.size(i), self.size(j)))
        for key, v in self._by(both, f"p{i}_{j}"):
            row = self.index(i)[tuple(key[at[f]] for f in own)] if i < self.y else 0
            out[row, b[0][tuple(key[at[f]] for f in a)] if b else 0] += v
        return out

    def sums(self, i: int) -> np.ndarray:
        """Sums of the columns of a term."""
        if i == self.y:
            return np.array([self._by([], f"s{i}")[0][1]])
        out = np.zeros(self.size(i))
        for key, v in self._by(self.terms[i].factors, f"s{i}"):
            out[self.index(i)[key]] = v
        return out

    def explained(self, big: int, i: int, j: int) -> np.ndarray:
        """The part of ``block(i, j)`` that the levels of a factor explain: over its levels, the sum of the products of both terms' sums by the level's rows."""
        if i > j:
            return self.explained(big, j, i).T
        level = F.col(self.terms[big].factors[0]).alias("level")
        plain = [k for k in (i, j) if not self.factors(k)]
        frame = self.cells.groupBy(level).agg(F.sum("n").alias("n"), *[F.sum(f"s{k}").alias(f"s{k}") for k in dict.fromkeys(plain)])
        at, values = [], []
        for side, k in (("a", i), ("b", j)):
            if own := self.factors(k):
                frame = frame.join(self.cells.groupBy(level, F.array(*own).alias(f"of_{side}")).agg(F.sum(f"s{k}").alias(side)), "level")
                at.append(f"of_{side}")
            values.append(F.col(side if own else f"s{k}"))
        out = np.zeros((self.size(i), self.size(j)))
        for r in frame.groupBy(*at).agg(F.sum(values[0] * values[1] / F.col("n")).alias("v")).collect():
            row, col = (self.index(k)[tuple(r[f"of_{side}"])] if self.factors(k) else 0 for side, k in (("a", i), ("b", j)))
            out[row, col] = r["v"] or 0.0
        return out

    def fits(self) -> list[tuple[int, float]]:
        """(rank, residual sum of squares) with no term, the first, the first two, and so on; the intercept is in all."""
        block, explained = cache(self.block), cache(self.explained)
        out = []
        for k in range(len(self.terms) + 1):
            main = [i for i in range(k) if len(self.terms[i].factors) == 1 and not self.terms[i].numbers]
            big = max(main, key=self.size, default=None)
            rest = [*[i for i in range(k) if i != big], self.y]
            columns = sum(self.size(i) for i in rest)
            if columns**2 > DENSE:
                raise ValueError(f"{columns} columns are more than the dense part may hold")
            whole = np.block([[block(i, j) for j in rest] for i in rest])
            if big is None:
                sums = np.concatenate([self.sums(i) for i in rest])
                left = whole - np.outer(sums, sums) / float(self.n or 1)
            else:
                left = whole - np.block([[explained(big, i, j) for j in rest] for i in rest])
            xx, xy, yy = left[:-1, :-1], left[:-1, -1], left[-1, -1]
            scale = np.sqrt(np.where(np.diag(whole)[:-1] > 0, np.diag(whole)[:-1], 1))
            value, vector = np.linalg.eigh(xx / np.outer(scale, scale)) if len(scale) else (np.zeros(0), np.zeros((0, 0)))
            held = value > 1e-9
            part = vector[:, held].T @ (xy / scale)
            out.append(((1 if big is None else self.size(big)) + int(held.sum()), float(yy - (part * part / value[held]).sum())))
        return out


def within(df: DataFrame, y: str, xs, absorb) -> tuple[int, int, np.ndarray, float]:
    """Rows, levels, cross-products of (xs, y) within the levels of ``absorb``, and the total sum of squares of y.

    Any number of levels: sums by level, then one aggregate over the levels.
    """
    xs, absorb = as_list(xs), as_list(absorb)
    rows = df.select(*absorb, *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate([*xs, y])]).na.drop()
    k = len(xs) + 1
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    means = rows.agg(*[F.avg(f"c{i}") for i in range(k)]).first()
    c = [F.col(f"c{i}") - F.lit(means[i] or 0.0) for i in range(k)]
    levels = rows.groupBy(*absorb).agg(F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(f"s{i}") for i, v in enumerate(c)], *[F.sum(c[i] * c[j]).alias(f"p{i}_{j}") for i, j in pairs])
    row = levels.agg(
        F.sum("n"), F.count(F.lit(1)), F.sum(f"p{k - 1}_{k - 1}"), *[F.sum(F.col(f"p{i}_{j}") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n")) for i, j in pairs]
    ).first()
    out = np.zeros((k, k))
    for (i, j), v in zip(pairs, row[3:]):
        out[i, j] = out[j, i] = v or 0.0
    return row[0] or 0, row[1], out, row[2] or 0.0
