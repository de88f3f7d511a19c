"""Benchmark decontamination by greedy string tiling.

Documents and test items are sequences of lower-cased words (A-Z only). Karp-Rabin fingerprints of
every ``seed`` consecutive words are kept where a bitmap built from the items may hold them; texts
of equal words stand together from then on. A document that holds the share ``coverage`` of an item
cannot do so with the item's most frequent seeds alone as long as these span less than that share:
only the other seeds are joined to find candidate pairs, so a line or passage common to many texts
pairs nobody. A second fingerprint confirms each seed. For every candidate pair the seeds of both
are gathered, each with its places on either side, never as a list of all matches. The longest run
of shared seeds is marked again and again, seeds that touch a marked word are gone, and the marked
share of the item is its coverage. Passages put in another order are found, as tiles need no
common order.

Defined results: null or blank texts match nothing; an item of fewer than ``seed`` words cannot
be matched and is never reported; rows that repeat both doc_id and text give one result row; rows
with one doc_id but other texts are judged apart; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SEED = 5
COVERAGE = 0.6
#: The bitmap has 32 bits a seed of the items, but 2 ** MOST_BITS at most (32 MB); beyond, more words enter the join.
MOST_BITS = 28
_SEED_ROWS = "id long, text_hash long, k1 long, k2 long, n_words int, seeds array<struct<h1:long,h2:long,at:array<int>>>"
_TILE_COLUMNS = ["n_tiles", "longest_tile", "covered_words", "item_words", "coverage"]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _may_hold(bits: np.ndarray, size: int, h: np.ndarray) -> np.ndarray:
    """Whether the bitmap of 2 ** size bits has both bits of each fingerprint."""
    out = np.ones(len(h), bool)
    for slot in (h >> np.uint64(64 - size), h & np.uint64((1 << size) - 1)):
        out &= (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def _seeds(seed: int, bitmap: Broadcast | None = None):
    """One row for each text with seeds: its words' fingerprint and its distinct seeds with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for at, _, w in C.word_chunks(batch.column("text"), lower=True):
                    one, two = w.hashes(0), w.hashes(1)
                    h1 = C.ngram_hashes(one, seed, 0)
                    owner = w.doc_of_word()
                    inside = owner[: len(h1)] == owner[seed - 1 :] if len(h1) else np.zeros(0, bool)
                    if bitmap is not None:
                        inside &= _may_hold(*bitmap.value, h1)
                    pos = np.flatnonzero(inside)
                    if not len(pos):
                        continue
                    h1, h2, doc = h1[pos], C.spans_hash(two, pos, pos + seed, 1), owner[pos]
                    order = np.lexsort((pos, h2, h1, doc))
                    h1, h2, doc, pos = h1[order], h2[order], doc[order], pos[order]
                    new = np.ones(len(pos), bool)
                    new[1:] = (doc[1:] != doc[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
                    first = np.flatnonzero(new)
                    places = pa.ListArray.from_arrays(pa.array(np.append(first, len(pos)).astype(np.int32)), pa.array((pos - w.first[doc]).astype(np.int32)))
                    kinds = pa.StructArray.from_arrays([_signed(h1[first]), _signed(h2[first]), places], ["h1", "h2", "at"])
                    begins = np.flatnonzero(np.diff(doc[first], prepend=-1))
                    texts = doc[first][begins]
                    rows, a, b = pa.array(at + texts), w.first[texts], w.first[texts + 1]
                    yield pa.record_batch(
                        [
                            batch.column("id").take(rows), batch.column("text_hash").take(rows), _signed(C.spans_hash(one, a, b, 0)), _signed(C.spans_hash(two, a, b, 1)),
                            pa.array((b - a).astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.append(begins, len(first)).astype(np.int32)), kinds),
                        ],
                        ["id", "text_hash", "k1", "k2", "n_words", "seeds"],
                    )

    return run


def tile(shared: list[tuple[np.ndarray, np.ndarray]], seed: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (document word, item word, length) from the places of each seed that document and item share.

    Longest first; ties by document position, then item position. Memory is linear in the places;
    a round visits each free place of the document once for every place of its seed in the item.
    """
    places = np.unique(np.concatenate([d for d, _ in shared])) if shared else np.zeros(0, np.int64)
    onward = np.append(np.diff(places) == 1, False) if len(places) else np.zeros(0, bool)
    held = {int(p): np.searchsorted(places, np.sort(d)) for d, i in shared for p in i}
    free, tiles = np.ones(len(places), bool), []
    run = np.zeros(len(places) + 1, np.int64)  # seeds in a row from a place of the document and the item's place just visited
    nowhere = np.zeros(0, np.int64)
    while held:
        best, before, last = (0, 0, 0), nowhere, -1
        for p in sorted(held, reverse=True):
            at = held[p][free[held[p]]]
            if last != p + 1:
                run[before] = 0
            n = 1 + run[at + 1] * onward[at]
            run[before] = 0
            run[at] = n
            before, last = at, p
            if len(at) and n.max() >= best[0]:
                longest = int(n.argmax())
                best = max(best, (int(n[longest]), -int(places[at[longest]]), -p))
        run[before] = 0
        if not best[0]:
            break
        size, d, i = best[0] + seed - 1, -best[1], -best[2]
        tiles.append((d, i, size))
        a, b = np.searchsorted(places, [d - seed + 1, d + size])
        free[a:b] = False
        for p in range(i - seed + 1, i + size):
            held.pop(p, None)
    return tiles


def _probes(seed: int, least: float) -> Callable[[pa.Table], pa.Table]:
    """The seeds of one item of which a document with enough of it must hold one: all but the most frequent."""

    def run(table: pa.Table) -> pa.Table:
        words = table.column("item_words")[0].as_py()
        rows = sorted(
            zip(table.column("n").to_pylist(), table.column("h1").to_pylist(), table.column("h2").to_pylist(), table.column("i").to_pylist(), range(table.num_rows)),
            key=lambda r: (-r[0], *r[1:3])
        )
        covered, spared = np.zeros(words, bool), 0
        for *_, places, _ in rows:
            for p in places:
                covered[p : p + seed] = True
            if covered.sum() >= least * words:
                break
            spared += 1
        return table.take(pa.array([r[-1] for r in rows[spared:]], pa.int64())).select(["i1", "i2", "h1", "h2"])

    return run


def _places(column: pa.ListArray) -> list[np.ndarray]:
    at, values = column.offsets.to_numpy(), column.values.to_numpy()
    return [values[a:b] for a, b in zip(at[:-1], at[1:])]


def _tiled(seed: int, least: float):
    keys = ["t1", "t2", "i1", "i2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, rows = [], []
            for j, words in enumerate(batch.column("item_words").to_pylist()):
                shared = batch.column("shared")[j].values
                tiles = tile(list(zip(_places(shared.field(0)), _places(shared.field(1)))), seed)
                covered = sum(n for _, _, n in tiles)
                if covered >= least * words:
                    rows.append(j)
                    found.append((len(tiles), tiles[0][2], covered, words, round(covered / words, 6)))
            kept = [batch.column(k).take(pa.array(rows, pa.int64())) for k in keys]
            values = [pa.array([f[c] for f in found], pa.int32() if c < 4 else pa.float64()) for c in range(5)]
            yield pa.record_batch([*kept, *values], [*keys, *_TILE_COLUMNS])

    return run


def _rows(table: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.select("id", "text", F.xxhash64("text").alias("text_hash"))


def _bitmap(sought: DataFrame) -> Broadcast:
    """(bits, log2 of their number) of the items' seeds: as large as they need, within 2 ** MOST_BITS."""
    size = min(MOST_BITS, max(16, (32 * sought.count()).bit_length()))
    slots = F.explode(F.array(F.shiftrightunsigned("h1", 64 - size), F.col("h1").bitwiseAND(F.lit((1 << size) - 1))))
    words = sought.select(slots.alias("slot")).groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(1 << size - 6, np.uint64)  # so many rows are collected at most
    bits[words.column("at").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return sought.sparkSession.sparkContext.broadcast((bits, size))


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", seed: int = SEED,
    coverage: float = COVERAGE
) -> DataFrame:
    """One row per document and item of which the document holds at least ``coverage``.

    Columns: doc_id, text_hash, item_id, n_tiles, longest_tile, covered_words, item_words, coverage.
    """
    tests = C.staged(_rows(items, item_col, item_text_col).mapInArrow(_seeds(seed), _SEED_ROWS), "items")
    alike = tests.dropDuplicates(["k1", "k2"])
    sought = C.staged(alike.select(F.col("k1").alias("i1"), F.col("k2").alias("i2"), F.col("n_words").alias("item_words"), F.inline("seeds").alias("h1", "h2", "i")), "sought")
    bitmap = _bitmap(sought)
    hits = C.staged(_rows(docs, id_col, text_col).mapInArrow(_seeds(seed, bitmap), _SEED_ROWS), "hits")
    texts = hits.dropDuplicates(["k1", "k2"])
    seen = C.staged(texts.select(F.col("k1").alias("t1"), F.col("k2").alias("t2"), F.inline("seeds").alias("h1", "h2", "d")), "seen")
    often = seen.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    told = sought.join(often, ["h1", "h2"]).select("i1", "i2", "item_words", "h1", "h2", "i", "n")
    probes = C.staged(told.groupBy("i1", "i2").applyInArrow(_probes(seed, coverage), "i1 long, i2 long, h1 long, h2 long"), "probes")
    pairs = C.staged(seen.select("t1", "t2", "h1", "h2").join(probes, ["h1", "h2"]).select("t1", "t2", "i1", "i2").distinct(), "pairs")
    shared = pairs.join(sought, ["i1", "i2"]).join(seen, ["t1", "t2", "h1", "h2"])
    gathered = shared.groupBy("t1", "t2", "i1", "i2", "item_words").agg(F.collect_list(F.struct("d", "i")).alias("shared"))
    tiled = gathered.mapInArrow(_tiled(seed, coverage), "t1 long, t2 long, i1 long, i2 long, n_tiles int, longest_tile int, covered_words int, item_words int, coverage double")
    found = C.staged(tiled, "tiled")
    named = found.join(tests.select(F.col("id").alias("item_id"), F.col("k1").alias("i1"), F.col("k2").alias("i2")), ["i1", "i2"])
    told_of = hits.select(F.col("id").alias("doc_id"), "text_hash", F.col("k1").alias("t1"), F.col("k2").alias("t2"))
    return named.join(told_of, ["t1", "t2"]).select("doc_id", "text_hash", "item_id", *_TILE_COLUMNS).distinct()


def without_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no item to the given coverage, with their columns unchanged."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    hits = C.staged(contaminated(docs, items, **options).select("doc_id", "text_hash").distinct(), "hits")
    same = F.col(f"d.{id_col}").cast("long").eqNullSafe(F.col("h.doc_id")) & (F.xxhash64(F.coalesce(F.col(f"d.{text_col}"), F.lit(""))) == F.col("h.text_hash"))
    return docs.alias("d").join(hits.alias("h"), same, "left_anti")


def op5_benchmark_decontamination(spark, sf_dir):
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text_hash")


QUERIES = {"op5_benchmark_decontamination": op5_benchmark_decontamination}
ORACLE: dict[str, str] = {}
