"""Exact substring deduplication by de Bruijn compaction.

Anchors are token k-mers sampled by window minimisers, so that every window of ``window`` words
holds at least one and equal windows hold the same ones. Consecutive anchors of a text are joined
by an edge that is labelled with the words between them. Counting anchors (one aggregate) tells
which repeat and after which the path never branches: there all occurrences go on with the same
edge, so a window inside such a nonbranching path is known to repeat without being looked at.
The branching ends are decided from source coordinates: their windows are fingerprinted with
128 bits, counted, and joined back. Nothing but fingerprints is shuffled for texts without a
repeated anchor.

Defined results: a null text has no words and an empty kept text; rows with a null or a repeated
doc_id are kept as rows of their own; a text that occurs twice repeats all its windows, so all its
words go where it has ``window`` of them; shorter texts lose nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW = 35
KMER = 12
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _anchors(w: C.Words, window: int, k: int):
    """(k-mer hashes, minimum of each window, window is valid, positions of the anchors)."""
    hashes = w.hashes()
    n = len(hashes)
    if n < window:
        return hashes, None, None, None, np.zeros(0, np.int64)
    kmers = C.ngram_hashes(hashes, k)
    kmers[kmers == 0] = 1
    span = window - k + 1
    least = C.sliding(kmers, span, np.minimum, _TOP)
    last = np.repeat(w.first[1:], np.diff(w.first))[: len(least)]
    valid = np.arange(len(least)) + window <= last
    held = np.where(valid, least, np.uint64(0))
    padded = np.concatenate([np.zeros(span - 1, np.uint64), held, np.zeros(span - 1, np.uint64)])
    chosen = C.sliding(padded, span, np.maximum, np.uint64(0))[: len(kmers)] == kmers
    return hashes, kmers, least, valid, np.flatnonzero(chosen)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _emit_anchors(window: int, k: int, with_edges: bool):
    """Anchor rows of each batch: fingerprint, and its outgoing edge or its source coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for at, to, w in C.word_chunks(batch.column("text")):
                    hashes, kmers, _, _, pos = _anchors(w, window, k)
                    if not len(pos):
                        continue
                    doc = np.searchsorted(w.first, pos, "right") - 1
                    if with_edges:
                        into, out = np.zeros(len(pos), np.uint64), np.zeros(len(pos), np.uint64)
                        same = np.flatnonzero(doc[1:] == doc[:-1])
                        out[same] = into[same + 1] = C.spans_hash(hashes, pos[same], pos[same + 1] + k, 1) | np.uint64(1)
                        yield pa.record_batch([_signed(kmers[pos]), _signed(into), _signed(out)], ["kmer", "into", "out"])
                    else:
                        rows = pa.array(at + doc)
                        yield pa.record_batch(
                            [_signed(kmers[pos]), batch.column("id").take(rows), batch.column("text_hash").take(rows), pa.array((pos - w.first[doc]).astype(np.int32))],
                            ["kmer", "id", "text_hash", "pos"],
                        )

    return run


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """A batch's rows as Python values, a few at a time."""
    for at in range(0, batch.num_rows, 128):
        yield from batch.slice(at, 128).to_pylist()


def _cover(starts: np.ndarray, n: int, window: int) -> np.ndarray:
    """Which of n words lie in a window that begins at one of ``starts``."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + window, -1)
    return np.cumsum(step[:n]) > 0


def _finish(w: C.Words, gone: np.ndarray) -> tuple[int, int, str]:
    kept = np.flatnonzero(~gone)
    raw = w.data.tobytes()
    text = b" ".join([raw[a:b] for a, b in zip(w.starts[kept].tolist(), w.ends[kept].tolist())])
    return len(gone), int(gone.sum()), hashlib.sha256(text).hexdigest(), text.decode("utf-8", "replace")


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])
_OPEN = pa.schema(
    [*_RESULT, ("row", pa.string()), ("text", pa.string()), ("sure", pa.list_(pa.int32())), ("first", pa.list_(pa.int32())), ("h1", pa.list_(pa.int64())), ("h2", pa.list_(pa.int64()))]
)


def _decide(window: int, k: int, keep_text: bool):
    """Texts with their repeated anchors: finished rows, or the windows that are still to be counted."""
    span = window - k + 1

    def one(text: str, pos: np.ndarray, back: np.ndarray, onward: np.ndarray):
        raw = np.frombuffer(text.encode(), np.uint8)
        w = C.Words(raw, np.array([0, len(raw)]))
        if not len(pos):
            return w, np.zeros(0, np.int64), np.zeros(0, np.int64), None
        hashes, kmers, least, valid, chosen = _anchors(w, window, k)
        seen = np.zeros(len(kmers), bool)
        seen[pos] = True
        repeated = np.where(seen, kmers, _TOP)
        starts = np.flatnonzero((C.sliding(repeated, span, np.minimum, _TOP) == least) & valid)
        # how far the nonbranching path through each anchor reaches: every occurrence of it shares these words
        goes, came = np.zeros(len(kmers), bool), np.zeros(len(kmers), bool)
        goes[pos], came[pos] = onward, back
        at = np.arange(len(chosen))
        to = chosen[np.minimum.accumulate(np.where(goes[chosen], len(chosen) - 1, at)[::-1])[::-1]] + k
        since = chosen[np.maximum.accumulate(np.where(came[chosen], 0, at))]
        # a window is judged by its own minimiser, so that equal windows are judged alike
        inner = starts + np.lib.stride_tricks.sliding_window_view(kmers, span)[starts].argmin(axis=1)
        anchor = np.searchsorted(chosen, inner)
        known = (since[anchor] <= starts) & (to[anchor] >= starts + window)
        sure, rest = starts[known], starts[~known]
        return w, sure, rest, hashes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                out, held = [], 0
                for r in _rows(batch):
                    marks = sorted({(m["pos"], m["back"], m["onward"]) for m in r["marks"] or ()})
                    pos = np.array([m[0] for m in marks], np.int64)
                    w, sure, rest, hashes = one(r["text"], pos, *(np.array([m[j] for m in marks], bool) for j in (1, 2)))
                    row = {"doc_id": r["id"]}
                    if len(rest):
                        ends = rest + window
                        row |= {
                            "row": r["row"], "text": r["text"], "sure": sure.astype(np.int32), "first": rest.astype(np.int32),
                            "h1": C.spans_hash(hashes, rest, ends, 0).view(np.int64), "h2": C.spans_hash(w.hashes(1), rest, ends, 1).view(np.int64),
                        }
                    else:
                        n, gone, digest, kept = _finish(w, _cover(sure, len(w.starts), window))
                        row |= {"n_words": n, "n_removed": gone, "kept_sha256": digest, "kept_text": kept if keep_text else None}
                    out.append(row)
                    held += len(r["text"]) + 24 * len(rest)
                    if held > 8 * C.CHUNK_BYTES:
                        yield pa.RecordBatch.from_pylist(out, _OPEN)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, _OPEN)

    return run


def _close(window: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in _rows(batch):
                raw = np.frombuffer(r["text"].encode(), np.uint8)
                w = C.Words(raw, np.array([0, len(raw)]))
                starts = np.array(sorted({*(r["sure"] or ()), *(r["found"] or ())}), np.int64)
                n, gone, digest, kept = _finish(w, _cover(starts, len(w.starts), window))
                out.append({"doc_id": r["doc_id"], "n_words": n, "n_removed": gone, "kept_sha256": digest, "kept_text": kept if keep_text else None})
            yield pa.RecordBatch.from_pylist(out, _RESULT)

    return run


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int = KMER, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and (unless ``keep_text`` is false) kept_text of every row."""
    if not 2 <= k <= window:
        raise ValueError("k must lie between 2 and the window")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    edges = rows.select("text").mapInArrow(_emit_anchors(window, k, True), "kmer long, into long, out long")
    ends = [F.min("into").alias("i0"), F.max("into").alias("i1"), F.min("out").alias("o0"), F.max("out").alias("o1")]
    repeated = C.staged(
        edges.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"), *ends).where("n > 1").select(
            "kmer", F.expr("i0 = i1 and i0 <> 0").alias("back"), F.expr("o0 = o1 and o0 <> 0").alias("onward")
        ),
        "anchors",
    )
    places = rows.mapInArrow(_emit_anchors(window, k, False), "kmer long, id long, text_hash long, pos int")
    marks = places.join(repeated, "kmer").groupBy("id", "text_hash").agg(F.collect_set(F.struct("pos", "back", "onward")).alias("marks"))
    joined = rows.alias("d").join(marks.alias("m"), F.expr("d.id <=> m.id and d.text_hash = m.text_hash"), "left").select("d.id", "d.text", F.expr("uuid()").alias("row"), "m.marks")
    decided = C.staged(
        joined.mapInArrow(
            _decide(window, k, keep_text),
            "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, row string, text string, sure array<int>, first array<int>, h1 array<long>, h2 array<long>",
        ),
        "windows",
    )
    result = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]
    done = decided.where("row is null").select(*result)
    left = decided.where("row is not null")
    windows = left.select("row", F.explode(F.arrays_zip("first", "h1", "h2")).alias("w")).select("row", "w.first", "w.h1", "w.h2")
    twice = C.staged(windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2"), "twice")
    found = windows.join(twice, ["h1", "h2"]).groupBy("row").agg(F.collect_list("first").alias("found"))
    rest = left.select("row", "doc_id", "text", "sure").join(found, "row", "left").mapInArrow(
        _close(window, keep_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    )
    out = done.unionByName(rest)
    return out if keep_text else out.drop("kept_text")


def op10_substring_dedup(spark, sf_dir):
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_text=False)


QUERIES = {"op10_substring_dedup": op10_substring_dedup}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
ORACLE = {
    "op10_substring_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
t AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
s AS (SELECT r, p, md5(array_to_string(list_slice(w, p, p + 34), ' ')) AS h
      FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)),
rep AS (SELECT h FROM s GROUP BY h HAVING count(*) > 1),
hit AS (SELECT r, p FROM s JOIN rep USING (h)),
m AS (SELECT t.r, t.p, t.word,
             coalesce(max(CASE WHEN hit.p IS NOT NULL THEN t.p END) OVER (PARTITION BY t.r ORDER BY t.p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), 0) > 0 AS gone
      FROM t LEFT JOIN hit ON hit.r = t.r AND hit.p = t.p),
g AS (SELECT r, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS kept FROM m GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(g.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(g.kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (r)"""
}
