"""Variable-capacity best-fit packing of documents into training sequences.

A document of more tokens than the largest capacity is cut into full pieces and a rest. Pieces
are dealt by a hash of their row into shards of bounded size, and each shard is packed by itself
with its histogram of lengths. For the largest piece left, every permitted length that holds it
is tried: the piece that fits the remaining room best is taken again and again, the trial bin is
downsized to its contents, and the length with the least cost per packed token is opened. A
token costs one, an open bin ``bin_cost`` besides.

Defined results: a null or blank text has no words and takes one token, its end mark; rows are
packed one for one, also with null or repeated ids (``row`` tells them apart); every token is in
exactly one bin; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

CAPACITIES = (256, 512, 1024, 2048, 4096)
BIN_COST = 16
#: Pieces a shard holds on average.
SHARD = 20_000


def word_tokens(text: Column) -> Column:
    """Words and one end mark."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long") + 1


def _trial(left: list[int], mask: int, room: int) -> list[tuple[int, int]]:
    """(length, how many) that best-fit takes from the histogram ``left`` into ``room``."""
    took = []
    while room:
        fits = mask & ((2 << room) - 1)
        if not fits:
            break
        length = fits.bit_length() - 1
        many = min(left[length], room // length)
        took.append((length, many))
        room -= length * many
        if many == left[length]:
            mask &= ~(1 << length)
        else:  # no room for another of this length
            mask &= (1 << length) - 1
    return took


def pack(lengths: list[int], capacities: tuple[int, ...], bin_cost: float) -> list[tuple[int, list[int]]]:
    """Bins (capacity, lengths inside) for pieces of the given lengths, none above the largest capacity."""
    sizes = sorted(capacities)
    left = [0] * (sizes[-1] + 1)
    mask = 0
    for n in lengths:
        left[n] += 1
        mask |= 1 << n
    bins = []
    while mask:
        largest = mask.bit_length() - 1
        left[largest] -= 1
        if not left[largest]:
            mask &= ~(1 << largest)
        best = None
        for size in sizes:
            if size < largest:
                continue
            took = _trial(left, mask, size - largest)
            used = largest + sum(n * k for n, k in took)
            closed = next(s for s in sizes if s >= used)
            score = ((closed + bin_cost) / used, -used)
            if best is None or score < best[0]:
                best = (score, closed, took)
        _, closed, took = best
        for n, k in took:
            left[n] -= k
            if not left[n]:
                mask &= ~(1 << n)
        bins.append((closed, [largest, *(n for n, k in took for _ in range(k))]))
    return bins


def _pack_shard(capacities: tuple[int, ...], bin_cost: float) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        pieces = table.sort_by([("row", "ascending"), ("piece", "ascending")])
        lengths = pieces.column("n_tokens").to_pylist()
        waiting: dict[int, list[int]] = defaultdict(list)
        for i in range(len(lengths) - 1, -1, -1):
            waiting[lengths[i]].append(i)
        order, bin_of, capacity, offset = [], [], [], []
        for b, (size, inside) in enumerate(pack(lengths, capacities, bin_cost)):
            at = 0
            for n in inside:
                order.append(waiting[n].pop())
                bin_of.append(b)
                capacity.append(size)
                offset.append(at)
                at += n
        out = pieces.take(pa.array(order, pa.int64()))
        bins = pa.array([(s << 32) + b for s, b in zip(out.column("shard").to_pylist(), bin_of)], pa.int64())
        out = out.select(["doc_id", "row", "piece", "start", "n_tokens"])
        for name, column in (("bin_id", bins), ("capacity", pa.array(capacity, pa.int32())), ("offset", pa.array(offset, pa.int32()))):
            out = out.append_column(name, column)
        return out

    return run


def best_fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None, capacities: tuple[int, ...] = CAPACITIES,
    bin_cost: float = BIN_COST, shard: int = SHARD
) -> DataFrame:
    """doc_id, row, piece, start, n_tokens, bin_id, capacity and offset of every piece of every row.

    ``tokens``: a column expression for a row's length, where words and an end mark are not wanted.
    """
    if not capacities or min(capacities) < 1:
        raise ValueError("capacities must be positive")
    top = max(capacities)
    count = word_tokens(F.col(text_col)) if tokens is None else F.greatest(F.coalesce(tokens, F.lit(1)), F.lit(1)).cast("long")
    lengths = C.staged(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), count.alias("n")), "lengths")
    whole = lengths.agg(F.sum(F.ceil(F.col("n") / top))).first()[0] or 0
    shards = max(1, -(-int(whole) // shard))
    pieces = lengths.select("doc_id", "row", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {top}"))).alias("piece")).select(
        "doc_id", "row", "piece", (F.col("piece") * top).alias("start"), F.least(F.lit(top).cast("long"), F.col("n") - F.col("piece") * top).alias("n_tokens"),
        F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).alias("shard"),
    )
    shape = "doc_id long, row long, piece long, start long, n_tokens long, bin_id long, capacity int, offset int"
    return pieces.groupBy("shard").applyInArrow(_pack_shard(tuple(capacities), bin_cost), shape)


def op2_best_fit_packing(spark, sf_dir):
    return best_fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_best_fit_packing": op2_best_fit_packing}
ORACLE: dict[str, str] = {}
