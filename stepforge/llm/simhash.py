"""SimHash near-duplicate groups by covering locality-sensitive hashing.

A fingerprint bit is the majority of that bit over the XXH64 values (seed 42) of all word
3-grams. For a radius r every bit position gets a nonzero label of r + 1 bits; for each nonzero
vector v of r + 1 bits, table v keeps the positions whose label has odd inner product with v. At
most r labels never span the space, so some v is orthogonal to all positions in which two
fingerprints within the radius differ: that table's mask hides the differences and the two
collide. Among the fingerprints that collide, those within the radius are linked by the values
half way between them, built from the table's hidden bits only. All holders of one such value
lie within the radius, so they are linked to their smallest in a star: no list of all pairs, no
limit on a bucket's size and no false link.

Defined results: a null or blank text has fingerprint zero and is linked like any other; rows
with a repeated or null doc_id keep a row each (a null id never names a component: where all ids
of a component are null, so is its name); other columns are ignored.

Scale: a table's key keeps 36 or 37 bits, so up to some 10**10 distinct fingerprints most keys are
held once and write nothing; beyond, each fingerprint writes up to 200 values half way.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import components

RADIUS = 2
SHINGLE = 3
SEED = 42


def _fingerprint(raw: bytes, shingle: int) -> int:
    words = raw.lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    if len(words) <= shingle:
        hashed = [xxhash.xxh64_intdigest(text, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = ends[:-shingle] - 0
        first = [0, *starts.tolist()]
        last = (ends[shingle - 1 :] - 1).tolist()
        hashed = list(map(xxhash.xxh64_intdigest, map(text.__getitem__, map(slice, first, last)), repeat(SEED)))
    h = np.array(hashed, np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = C.text_buffers(batch.column("text"))
            found = [_fingerprint(data[a:b].tobytes(), shingle) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit number, of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """The 2**(radius + 1) - 1 masks of kept bits; any ``radius`` positions are all hidden by one of them."""
    size = 1 << (radius + 1)
    labels = [i % (size - 1) + 1 for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (labels[i] & v).bit_count() & 1) for v in range(1, size)]


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between representatives ``node`` of distinct fingerprints ``fp`` that span every link within the radius (0, 1 or 2)."""
    if not 0 <= radius <= 2:
        raise ValueError("values half way between two fingerprints are defined for a radius of at most 2")
    masks = covering_masks(radius)
    tables = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_long(m))).alias("key")) for i, m in enumerate(masks)]))
    hashed = fps.select("node", "fp", tables.alias("b")).select("node", "fp", "b.t", "b.key")
    shared = C.staged(hashed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("t", "key"), "buckets")
    hidden = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(_long(1 << i)) for i in range(64) if not m >> i & 1]) for m in masks])
    flips = F.explode(F.element_at(hidden, F.col("t") + 1)) if radius else F.lit(0)
    middle = hashed.join(shared, ["t", "key"]).select("node", "fp", flips.alias("flip")).select("node", F.col("fp").bitwiseXOR(F.col("flip")).alias("middle")).distinct()
    middle = C.staged(middle, "middle")
    star = C.staged(middle.groupBy("middle").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("middle", "b"), "stars")
    return middle.join(star, "middle").where("node <> b").select(F.col("node").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, more: DataFrame | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links, and over ``more`` (a, b) edges of doc_ids."""
    marked = C.staged(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    # distinct fingerprints stand for all their copies from here on, and are the nodes of the graph
    fps = C.staged(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    edges = links(fps.select(F.col("fp").alias("node"), "fp"), radius)
    if more is not None:
        name = marked.where("doc_id is not null").distinct()
        edges = edges.unionByName(
            more.join(name.select(F.col("doc_id").alias("a"), F.col("fp").alias("x")), "a").join(name.select(F.col("doc_id").alias("b"), F.col("fp").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        )
    joined = components(edges).withColumnRenamed("node", "fp")
    held = C.staged(fps.join(joined, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component")), "components")
    named = C.staged(held.select("fp", "component").join(held.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("fp", "component_id"), "named")
    out = marked.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
    return out


def op4_simhash_near_dedup(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_simhash_near_dedup": op4_simhash_near_dedup}
ORACLE: dict[str, str] = {}
