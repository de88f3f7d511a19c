"""Sums of cross-products of many columns, in one pass that combines before its exchange."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many columns every pair is an aggregate of its own; more are summed as matrices, a task at a time.
WIDE = 24


def cross_products(rows: DataFrame, cols: list[Column], weight: Column | None = None, extra: list[Column] | None = None) -> tuple[np.ndarray, list]:
    """The matrix of sums of weight * c_i * c_j, and the values of further aggregates, over all ``rows``."""
    p, extra = len(cols), extra or []
    cells = [c.cast("double") for c in cols]
    if p > WIDE:
        return _by_matrices(rows, cells, weight), list(rows.agg(*extra).first()) if extra else []
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    one = lambda i, j: cells[i] * cells[j] if weight is None else weight * cells[i] * cells[j]
    row = rows.agg(*[F.sum(one(i, j)).alias(f"m{k}") for k, (i, j) in enumerate(pairs)], *[e.alias(f"e{k}") for k, e in enumerate(extra)]).first()
    out = np.zeros((p, p))
    for k, (i, j) in enumerate(pairs):
        out[i, j] = out[j, i] = row[k] or 0.0
    return out, list(row[len(pairs) :])


def _by_matrices(rows: DataFrame, cells: list[Column], weight: Column | None) -> np.ndarray:
    p = len(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((p, p))
        for b in batches:
            x = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(p)])
            total += (x * b.column(p).to_numpy(zero_copy_only=False)[:, None]).T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(p), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "v"])

    given = rows.select(*[c.alias(f"c{i}") for i, c in enumerate(cells)], (F.lit(1.0) if weight is None else weight.cast("double")).alias("w"))
    sums = given.mapInArrow(run, "i int, v array<double>").groupBy("i").agg(*[F.sum(F.col("v")[j]).alias(f"s{j}") for j in range(p)])
    out = np.zeros((p, p))
    for i, *s in sums.collect():  # as many rows as columns
        out[i] = s
    return out
