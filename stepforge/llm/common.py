"""Shared pieces: intermediate tables in the shared folder, and vectorised word hashing.

Word hashing works on the Arrow buffers of a whole batch: texts are never turned into Python
strings. A word is a run of bytes other than space and the five ASCII control blanks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.storage import drop, scratch, shared_dir, staged  # noqa: F401  for the operators of this subpackage

U64 = np.uint64
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True

#: Odd multipliers of the two independent polynomial hashes, and their inverses modulo 2**64.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)
_BYTE_CODES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
#: Texts are taken together up to this many bytes, so that temporaries stay within the CPU caches.
CHUNK_BYTES = 1 << 20


#: Elements whose prefixes are gathered together: arrays grow by copies, so long ones are put together from these.
_PREFIX = 256


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, also where it is used for each element of an array."""
    return F.element_at(F.transform(F.array(value), use), 1)


def prefixes(values: Column, first: Column, join) -> Column:
    """The fold of an array of ints before each element, from ``first`` on; ``join`` is associative. Work grows with the array, not with its square."""
    none, nones = F.array().cast("array<int>"), F.array().cast("array<array<int>>")
    both = lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(join(a, b))
    state = lambda at, kept: F.struct(at.cast("int").alias("at"), kept.alias("kept"))
    inside = lambda block: F.aggregate(block, state(F.lit(None), none), lambda acc, n: state(both(acc["at"], n), F.concat(acc["kept"], F.array(acc["at"]))))
    cut = lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / _PREFIX).cast("int")), lambda k: inside(F.slice(s, k * _PREFIX + 1, _PREFIX)))
    ahead = lambda at, kept: F.zip_with(kept, F.array_repeat(at, F.size(kept)), lambda x, a: both(a, x))
    whole = F.aggregate(let(values, cut), state(first, nones), lambda acc, b: state(both(acc["at"], b["at"]), F.concat(acc["kept"], F.array(ahead(acc["at"], b["kept"])))))
    return F.flatten(whole["kept"])


def new_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (public-domain constants)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls up to the longest asked for."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 64)
        have = np.full(size, base & (1 << 64) - 1, np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Karp-Rabin fingerprint of values[start:end] for each span, by prefix sums modulo 2**64."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(_BASES[which], n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(_INVERSES[which], n + 1)[starts])


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string column without nulls or views."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return offsets, data


class Words:
    """The words of consecutive texts: byte spans, word hashes and each text's first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        base = offsets[0]
        self.data, self.offsets = data[base : offsets[-1]], offsets - base
        if lower:
            upper = (self.data >= 65) & (self.data <= 90)
            self.data = np.where(upper, self.data + 32, self.data).astype(np.uint8)
        word = ~BLANK[self.data]
        n = len(word)
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before = np.zeros(n, bool)
        before[1:] = word[:-1]
        self.starts = np.flatnonzero(word & (~before | edge[:n]))
        after = np.zeros(n, bool)
        after[:-1] = word[1:]
        self.ends = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, self.offsets)

    def hashes(self, which: int = 0) -> np.ndarray:
        return spans_hash(_BYTE_CODES[self.data], self.starts, self.ends, which)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def word_chunks(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    """(first text, end text, Words) over a batch, about CHUNK_BYTES at a time; one text is never split."""
    offsets, data = text_buffers(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        yield at, to, Words(data, offsets[at : to + 1], lower)
        at = to


def ngram_hashes(hashes: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """Fingerprints of every n consecutive values; those that cross a text's end are the caller's to drop."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    at = np.arange(len(hashes) - n + 1)
    return spans_hash(hashes, at, at + n, which)


def sliding(values: np.ndarray, width: int, fn: np.ufunc, pad) -> np.ndarray:
    """fn over values[i:i+width] for every i with a full window, in three passes whatever the width."""
    n = len(values)
    if n < width:
        return values[:0]
    blocks = -(-n // width)
    full = np.full(blocks * width, pad, values.dtype)
    full[:n] = values
    rows = full.reshape(blocks, width)
    left = fn.accumulate(rows, axis=1).ravel()
    right = fn.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return fn(right[: n - width + 1], left[width - 1 : n])
