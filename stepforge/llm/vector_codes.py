"""Operator 12: vectors as codes of a few bytes, by codebooks whose nearest entries a trie finds.

Components become integers, floor(scale * x), and vectors are cut into consecutive parts. Spark counts the
distinct parts of each position and deals them, in lexicographic order, into ranges; so each task reads a
run of the leaves of a trie whose nodes are prefixes. The run is traversed depth first: a stack holds, for
each depth of the present path, the vector of squared distances to all entries gathered over that prefix,
and the next part takes over the levels that it shares with its predecessor. A leaf's vector gives the
nearest entry (argmin: the lower index of equals) and adds the part, as often as it occurs, to that entry's
sum. A round sends at most one row per entry and task to the exchange; codebooks, whose size is a parameter,
are all that the driver holds. Vectors are coded where they lie, with a trie of the distinct parts of each
batch, so that no copy travels to meet its code.

Defined cases: vectors that are null or hold a null or a component that is not finite are dropped (and
only those); vectors shorter than the longest, empty ones too, are filled up with zeros, as are vectors whose length the parts do
not divide; fewer vectors than ``entries`` give as many entries; null ids come last among the first
entries, equal ids by vector; equal vectors share a code; an empty table gives no rows. Components whose
squared distances no long could hold raise ValueError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024


@dataclass(frozen=True)
class Codebooks:
    """``entries`` by part, entry and position; ``largest`` bounds the size of any component, of entries too."""

    entries: np.ndarray
    largest: int
    scale: int

    @property
    def width(self) -> int:
        return self.entries.shape[2]

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def table(self, spark) -> DataFrame:
        rows = [(p, e, [int(x) for x in v]) for p, book in enumerate(self.entries) for e, v in enumerate(book)]
        return spark.createDataFrame(rows, "part int, entry int, components array<long>")


def nearest(parts: np.ndarray, book: np.ndarray, largest: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest entry of each part; parts that ascend share most."""
    n, width = parts.shape
    # half as wide where no distance can exceed it
    kind = np.int32 if width * (2 * largest) ** 2 < 2**31 else np.int64
    parts, columns = parts.astype(kind), np.ascontiguousarray(book.T.astype(kind))
    differ = parts[1:] != parts[:-1]
    shared = np.concatenate([[0], np.where(differ.any(1), differ.argmax(1), width)])
    stack = np.zeros((width + 1, len(book)), kind)
    index, distance = np.empty(n, np.int64), np.empty(n, np.int64)
    for i in range(n):
        depth = shared[i]
        if depth < width:
            step = columns[depth:] - parts[i, depth:, None]
            step *= step
            step[0] += stack[depth]
            np.cumsum(step, axis=0, out=stack[depth + 1 :])
        leaf = stack[width]
        index[i] = at = leaf.argmin()
        distance[i] = leaf[at]
    return index, distance


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _tally(books: Codebooks):
    """Weighted sums and counts of the parts nearest to each entry, one row per entry and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, width = books.entries.shape[1:]
        sums, counts = np.zeros((len(books.entries), k, width), np.int64), np.zeros((len(books.entries), k), np.int64)
        for batch in batches:
            at, weight = batch.column("part").to_numpy(), batch.column("n").to_numpy()
            rows = _matrix(batch.column("v"), width)
            for p in np.unique(at):
                own = at == p
                index, _ = nearest(rows[own], books.entries[p], books.largest)
                np.add.at(sums[p], index, rows[own] * weight[own, None])
                np.add.at(counts[p], index, weight[own])
        part, entry = np.nonzero(counts)
        if len(part):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]),
                    pa.array(sums[part, entry].tolist(), pa.list_(pa.int64()))
                ], names=["part", "entry", "n", "s"]
            )

    return run


def _kept(df: DataFrame, vec_col: str, scale: int) -> DataFrame:
    """``df`` without the vectors to drop; ``__v`` has the scaled integers."""
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return df.where(finite).withColumn("__v", F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale)))


def _filled(v, size: int):
    return F.concat(v, F.array_repeat(F.lit(0).cast("long"), F.lit(size) - F.size(v)))


def train(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks that begin with the vectors of the smallest ids and move to the floor of the mean of their parts in each round."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index must fit two hexadecimal digits")
    size, most = df.where(F.forall(vec_col, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))).agg(
        F.max(F.size(vec_col)), F.max(F.array_max(F.transform(vec_col, lambda x: F.abs(x.cast("double")))))
    ).first()
    width, largest = max(1, -(-(size or 0) // parts)), int((most or 0.0) * scale) + 1
    if parts * width * (2 * largest) ** 2 >= 2**62:
        raise ValueError(f"components up to {most} are too large for distances in longs")
    rows = _kept(df, vec_col, scale).select(F.col(id_col).alias("id"), _filled(F.col("__v"), parts * width).alias("v"))
    first = [r["v"] for r in rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()]
    books = np.array(first, np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    if not first:
        return Codebooks(books, largest, scale)
    cut = F.array(*[F.struct(F.lit(p).alias("part"), F.slice("v", p * width + 1, width).alias("v")) for p in range(parts)])
    counted = rows.select(F.inline(cut)).groupBy("part", "v").agg(F.count(F.lit(1)).alias("n"))
    distinct = C.staged(counted.repartitionByRange("part", "v").sortWithinPartitions("part", "v"), "parts")
    for _ in range(rounds):
        tallied = distinct.mapInArrow(_tally(Codebooks(books, largest, scale)), "part int, entry int, n long, s array<long>")
        sums = tallied.groupBy("part", "entry").agg(F.sum("n"), *[F.sum(F.col("s")[i]) for i in range(width)]).collect()  # one row an entry at most
        books = books.copy()
        for part, entry, n, *s in sums:
            books[part, entry] = [x // n for x in s]
    return Codebooks(books, largest, scale)


def _encode(books: Codebooks, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _, width = books.entries.shape
        for batch in batches:
            rows = _matrix(batch.column("__v"), parts * width)
            codes, error = np.empty((len(rows), parts), np.uint8), np.zeros(len(rows), np.int64)
            for p in range(parts):
                own = rows[:, p * width : (p + 1) * width]
                order = np.lexsort(own.T[::-1])
                own = own[order]
                new = np.concatenate([[True], (own[1:] != own[:-1]).any(1)])[: len(own)]
                index, distance = nearest(own[new], books.entries[p], books.largest)
                leaf = np.cumsum(new) - 1
                codes[order, p] = index[leaf]
                error[order] += distance[leaf]
            text = pa.array([c.tobytes().hex() for c in codes], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], text, pa.array(error)], names=[*keep, "code", "error"])

    return run


def encode(df: DataFrame, books: Codebooks, keep=("vec_id", "label"), vec_col: str = "embedding") -> DataFrame:
    """The columns ``keep`` of every vector not dropped, its code (two hexadecimal digits a part) and error (squared distance to what the code stands for)."""
    keep, size = list(keep), books.entries.shape[0] * books.width
    rows = _kept(df, vec_col, books.scale).select(*keep, _filled(F.col("__v"), size).alias("__v"))
    kinds = T.StructType([*[rows.schema[c] for c in keep], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return rows.mapInArrow(_encode(books, keep), kinds)


def restored(coded: DataFrame, books: Codebooks) -> DataFrame:
    """``coded`` with approx, the scaled integers that each code stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = np.arange(len(books.entries))
        for batch in batches:
            index = np.frombuffer(bytes.fromhex("".join(batch.column("code").to_pylist())), np.uint8).reshape(batch.num_rows, len(part))
            whole = books.entries[part, index].reshape(batch.num_rows, -1)
            yield batch.append_column("approx", pa.array(whole.tolist(), pa.list_(pa.int64())))

    return coded.mapInArrow(run, T.StructType([*coded.schema.fields, T.StructField("approx", T.ArrayType(T.LongType()))]))


def op12_vector_codes(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    books = train(vectors)
    coded = C.staged(encode(vectors, books), "coded")
    total = coded.groupBy(F.col("label").alias("same")).agg(F.sum("error").alias("label_error"))
    out = coded.join(total, F.col("label").eqNullSafe(F.col("same")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


QUERIES = {"op12_vector_codes": op12_vector_codes}


def _round(i: int) -> str:
    return f"""
a{i} AS MATERIALIZED (SELECT r, p, min({{'q': q, 'e': e}}) AS m FROM (SELECT r, p, e, sum((x - c) * (x - c)) AS q FROM parts JOIN b{i} USING (p, d) GROUP BY r, p, e) GROUP BY r, p)"""


def _moved(i: int) -> str:
    return f"""
b{i + 1} AS MATERIALIZED (SELECT b{i}.p, b{i}.e, b{i}.d, coalesce(CAST(floor_mean AS BIGINT), c) AS c FROM b{i} LEFT JOIN (
  SELECT p, m.e AS e, d, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS floor_mean FROM parts JOIN a{i} USING (r, p) GROUP BY p, m.e, d) USING (p, e, d))"""


ORACLE = {
    "op12_vector_codes": f"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT r, i // (n // {PARTS}) AS p, i % (n // {PARTS}) AS d, x FROM (SELECT r, len(v) AS n, unnest(range(len(v))) AS i, unnest(v) AS x FROM k)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS e, d, x AS c FROM parts WHERE r <= {ENTRIES}),
{",".join(x for i in range(ROUNDS) for x in (_round(i), _moved(i)))},{_round(ROUNDS)},
s AS (SELECT sha256(string_agg(c, ',' ORDER BY p, e, d)) AS codebooks_sha256 FROM b{ROUNDS}),
f AS (SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.q) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN f USING (r), s"""
}
