"""Links between near copies: texts whose sets of five-word shingles agree to 0.8 or more.

Equal texts (by their words, A-Z lower-cased) stand together from the start. Every distinct text
has a sketch, the ``SKETCH`` least fingerprints of its shingles; the least of two texts' union are
a random sample of it, so texts that agree to 0.8 share ``needed`` members or more, but for one
pair in a million. Members in one text only cannot be shared, so a text with too many of them has
no partner and is done; nearly all texts are.

The others are filed ``FILES`` times, each time under the least of its shingles by another hash: two
texts that agree to 0.8 lie in one file of nine but for one pair in two million. In a file of up to
``SMALL`` texts all meet. In a larger one all meet its most central text, the pivot; those like it
are one group and need no more of each other. Those unlike it meet all texts of the file, in blocks:
a task holds a block of each side, of some ``BLOCK`` shingles, counts all intersections by an
inverted list, and returns no more edges than it takes to join what it found. So no link is lost
behind a pivot, no pairs are listed, and no limit is set on a file; the work of the blocks grows
with the texts unlike the pivot times those of the file.

Defined results: a text of fewer than five words is one shingle; null and blank texts are equal;
ids must tell rows apart, and rows without one are not linked; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

SHINGLE = 5
SIMILARITY = 0.8
SKETCH = 64
#: Hashes by which the texts are filed.
FILES = 9
#: Texts of a file that all meet one another.
SMALL = 16
#: Shingles of a block.
BLOCK = 1 << 20
#: Standard deviations below the mean of a sample's shared members that still count as candidates.
SLACK = 4.9


def _shingles(w: C.Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprints of all texts' distinct shingles, least first in each text, where each text's begin and the end, two fingerprints of each whole text)."""
    h = w.hashes()
    n = np.diff(w.first)
    many = np.maximum(n - size + 1, 1)
    begin = np.concatenate([[0], np.cumsum(many)])
    start = np.repeat(w.first[:-1] - begin[:-1], many) + np.arange(begin[-1])
    end = np.minimum(start + size, np.repeat(w.first[1:], many))
    owner = np.repeat(np.arange(len(n)), many)
    g = C.spans_hash(h, start, end)
    order = np.lexsort((g, owner))
    g = g[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
    begin = np.searchsorted(owner[new], np.arange(len(n) + 1))
    return g[new], begin, C.spans_hash(h, w.first[:-1], w.first[1:], 1), C.spans_hash(w.hashes(1), w.first[:-1], w.first[1:])


def _listed(values: np.ndarray, begin: np.ndarray, most: int | None) -> pa.ListArray:
    """The values of each text, the first ``most`` of them where given."""
    rank = np.arange(len(values)) - np.repeat(begin[:-1], np.diff(begin))
    kept = values if most is None else values[rank < most]
    sizes = np.diff(begin) if most is None else np.minimum(np.diff(begin), most)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(kept.view(np.int64)))


def _members(shingle: int, most: int | None, files: int = 0):
    """id, two fingerprints of the words, the number of distinct shingles, and the least of them (all where ``most`` is None); the least by each of ``files`` other hashes."""
    salts = C.mix(np.arange(1, files + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for at, to, w in C.word_chunks(batch.column("text"), lower=True):
                    g, begin, one, two = _shingles(w, shingle)
                    columns = [
                        batch.column("id").slice(at, to - at), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                        pa.array(np.diff(begin).astype(np.int32)), _listed(g, begin, most)
                    ]
                    if files:
                        least = [C.mix(np.minimum.reduceat(C.mix(g ^ s), begin[:-1]) + s) for s in salts]
                        columns.append(pa.ListArray.from_arrays(pa.array(np.arange(to - at + 1, dtype=np.int32) * files), pa.array(np.column_stack(least).ravel().view(np.int64))))
                    yield pa.record_batch(columns, ["id", "one", "two", "n", "members"] + ["files"] * bool(files))

    return run


def needed(similarity: float, size: int) -> int:
    """Members that the full sketches of two texts of this similarity share, but for about one pair in a million."""
    return max(1, math.floor(size * similarity - SLACK * math.sqrt(size * similarity * (1 - similarity))))


def _least_shared(n: Column, similarity: float, size: int) -> Column:
    """Members that a text of ``n`` distinct shingles shares with any partner; exact for small sets."""
    return F.least(F.lit(needed(similarity, size)), F.ceil(F.least(n, F.lit(size)) * F.lit(similarity) - F.lit(1e-9))).cast("int")


def _alike(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, similarity: float, size: int) -> DataFrame:
    """The (a, b) ``pairs`` that agree to ``similarity`` or more: by sketches first, then by whole sets."""

    def met(some: DataFrame, members: DataFrame) -> DataFrame:
        left, right = members.select(F.col("node").alias("a"), F.col("members").alias("x")), members.select(F.col("node").alias("b"), F.col("members").alias("y"))
        return some.join(left, "a").join(right, "b")

    both = F.size(F.array_intersect("x", "y"))
    given = C.staged(pairs, "pairs")
    close = C.staged(met(given, sketches).where(both >= _least_shared(F.greatest(F.size("x"), F.size("y")), similarity, size)).select("a", "b"), "close")
    alike = C.staged(met(close, sets).where(both >= similarity * (F.size("x") + F.size("y") - both)).select("a", "b"), "alike")
    C.drop(given, close)
    return alike


def joined(u: list[np.ndarray], m: list[np.ndarray], same: np.ndarray, place: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """(i, j): edges between sets of ``u`` and of ``m`` that agree to ``similarity``, enough to join all that such pairs join.

    ``same``: which of ``m`` are one group already; ``place``: where in ``m`` each of ``u`` is itself, or -1.
    """
    size = np.array([len(x) for x in m])
    token = np.concatenate(m) if len(m) else np.zeros(0, np.int64)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], np.repeat(np.arange(len(m)), size)[order]
    group, out = np.arange(len(m)), []
    group[same] = np.flatnonzero(same)[0] if same.any() else 0
    for i, x in enumerate(u):
        low, high = np.searchsorted(token, x), np.searchsorted(token, x, "right")
        n = high - low
        at = np.arange(n.sum()) + np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        both = np.bincount(owner[at], minlength=len(m))
        like = both >= similarity * (len(x) + size - both)
        like &= np.arange(len(m)) != place[i]
        found, where = np.unique(group[like], return_index=True)
        if place[i] >= 0:  # what it is joined to already needs no edge
            keep = found != group[place[i]]
            found, where = found[keep], where[keep]
        out += [(i, j) for j in np.flatnonzero(like)[where].tolist()]
        if len(found):
            group[np.isin(group, np.append(found, group[place[i]]) if place[i] >= 0 else found)] = found[0]
    return out


def _block(similarity: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        lists = lambda t: [x.to_numpy(zero_copy_only=False) for x in (v.values for v in t.column("members").combine_chunks())]
        a, b = left.column("node").to_numpy(), right.column("node").to_numpy()
        if not len(a) or not len(b):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        by = np.argsort(b)
        at = by[np.minimum(np.searchsorted(b, a, sorter=by), len(b) - 1)]
        edges = joined(lists(left), lists(right), right.column("like").to_numpy(zero_copy_only=False).astype(bool), np.where(b[at] == a, at, -1), similarity)
        return pa.table({"a": pa.array([a[i] for i, _ in edges], pa.int64()), "b": pa.array([b[j] for _, j in edges], pa.int64())})

    return run


def resembling(filed: DataFrame, sketches: DataFrame, sets: DataFrame, similarity: float = SIMILARITY, size: int = SKETCH, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that join all nodes of a file whose sets agree to ``similarity``, directly or by others.

    Rows (g, node, w, n) of ``filed``: a file's key, a node in it, its weight (the heaviest is the pivot) and the size of its set; sketches and
    sets: node, members.
    """
    heaviest = F.max(F.struct("w", F.xxhash64("node").alias("h"), F.col("node").alias("pivot")))["pivot"].alias("pivot")
    files = filed.groupBy("g").agg(F.count(F.lit(1)).alias("k"), heaviest, F.sum("n").alias("whole")).where("k > 1")
    rows = C.staged(filed.join(files, "g").select("g", "node", "n", "k", "pivot", "whole"), "rows")
    few = rows.where(F.col("k") <= small).select("g", "node")
    every = few.select("g", F.col("node").alias("a")).join(few.select("g", F.col("node").alias("b")), "g").where("a < b").select("a", "b")
    many = rows.where(F.col("k") > small)
    central = many.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    alike = _alike(every.unionByName(central).distinct(), sketches, sets, similarity, size)
    told = many.join(alike.select(F.col("a").alias("node"), F.col("b").alias("pivot"), F.lit(True).alias("yes")), ["node", "pivot"], "left")
    told = C.staged(told.select("g", "node", "n", "whole", (F.coalesce("yes", F.lit(False)) | (F.col("node") == F.col("pivot"))).alias("like")), "told")
    apart = told.where("not like").groupBy("g").agg(F.sum("n").alias("others"))
    parts = lambda c: F.ceil(F.col(c) / block).cast("int")
    told = told.join(apart, "g").withColumns({"us": parts("others"), "ms": parts("whole")})
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = told.where("not like").select("g", "node", own("us").alias("u"), upto("ms").alias("m")).join(sets, "node")
    right = told.select("g", "node", "like", own("ms").alias("m"), upto("us").alias("u")).join(sets, "node")
    keys = ["g", "u", "m"]
    fresh = lambda df, *more: df.select(*[F.col(c).alias(c) for c in (*keys, "node", "members", *more)])  # noqa: E731  both come of the same tables
    met = fresh(left).groupBy(*keys).cogroup(fresh(right, "like").groupBy(*keys)).applyInArrow(_block(similarity), "a long, b long")
    return alike.unionByName(met)


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, size: int = SKETCH) -> DataFrame:
    """Edges (a, b) of ids whose texts' shingle sets agree to ``similarity`` or more; equal texts are named by their smallest id."""
    given = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shape = "id long, one long, two long, n int, members array<long>"
    sketched = given.mapInArrow(_members(shingle, size), shape)
    texts = C.staged(sketched.groupBy("one", "two").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("members").alias("members")).select("node", "n", "members"), "texts")
    members = texts.select("node", "n", F.explode("members").alias("g"))
    often = C.staged(members.groupBy("g").agg(F.count(F.lit(1)).alias("often")).where("often > 1"), "often")
    known = members.join(often, "g").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("often", "g"))).alias("known"))
    least = _least_shared(F.col("n"), similarity, size)
    weight = F.aggregate("known", F.lit(0).cast("long"), lambda t, k: t + k["often"]) / F.least(F.col("n"), F.lit(size))
    asked = C.staged(known.where(F.size("known") >= least).select("node", weight.alias("w")), "asked")
    short = F.transform("members", lambda g: F.shiftright(g, 32).cast("int"))  # enough to tell members of two sketches apart
    sketches = C.staged(texts.join(asked, "node", "left_semi").select("node", short.alias("members")), "sketches")
    chosen = given.join(asked.select(F.col("node").alias("id")), "id", "left_semi")
    sets = C.staged(chosen.mapInArrow(_members(shingle, None, FILES), shape + ", files array<long>").select(F.col("id").alias("node"), "n", "members", "files"), "sets")
    filed = sets.select("node", "n", F.explode("files").alias("g")).join(asked, "node")
    return resembling(filed, sketches, sets.select("node", "members"), similarity, size)
