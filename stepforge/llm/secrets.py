"""Secret scans with multipart credential linking.

Well-formed parts (assignments, access identifiers, long hex strings) are reported as they are.
Weak candidates are parts that alone mean little: a capital identifier (role A), a mixed-case
random-looking string (role S), an endpoint (role E). An interval join links each of them with the
parts of other roles whose interval lies within its scope, ``reach`` code points to either side: a
weak secret needs an identifier in scope, a weak identifier needs a secret, an endpoint needs both
(or it stays unreported). The join is a left semi join on (row, tile of the text), so it lists no
pairs, and one row per part and touched tile crosses the network.

Spans are code points, end exclusive. Defined results: a null or blank text has no spans; rows are
kept one for one, whatever their id; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

REACH = 160
KINDS = ("assign", "access", "hex", "identifier", "random", "endpoint")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LONG = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
ENDPOINT = re.compile(
    r"(?:https?|wss?|s3|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+|(?<![A-Za-z0-9.-])(?:[A-Za-z0-9-]{1,63}\.)+(?:amazonaws\.com|azure\.com|googleapis\.com)"
)
WORDS = ("passw", "secret", "token", "api")


def entropy(s: str) -> float:
    """Bits per character of a string's own letter frequencies."""
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the well-formed parts, leftmost and non-overlapping within each kind."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def weak_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Weak candidates (start, kind number, end) that overlap no well-formed part."""
    out = []
    for m in LONG.finditer(text):
        s = m[0]
        digits = sum(c.isdigit() for c in s)
        if not digits or digits == len(s):
            continue
        if re.fullmatch(r"[A-Z0-9]{16,32}", s):
            out.append((m.start(), 3, m.end()))
        elif any("a" <= c <= "z" for c in s) and any("A" <= c <= "Z" for c in s) and len(s) >= 20 and entropy(s) >= 3.7:
            out.append((m.start(), 4, m.end()))
    if "://" in text or ".com" in text:
        out += [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    starts, reached = [b[0] for b in base], [-1, *accumulate((b[2] for b in base), max)]
    return sorted(x for x in out if reached[bisect_left(starts, x[2])] <= x[0])


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    for batch in batches:
        counts, digests, bases, weaks = [], [], [], []
        for text in batch.column("text"):
            text = text.as_py()
            base = base_spans(text)
            weak = weak_spans(text, base)
            counts.append([sum(k == j for _, k, _ in base) for j in range(3)])
            digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
            bases.append([{"start": a, "kind": k, "end": b} for a, k, b in base])
            weaks.append([{"start": a, "kind": k, "end": b} for a, k, b in weak])
        yield pa.record_batch(
            [
                batch.column("doc_id"), batch.column("row"), *(pa.array([c[j] for c in counts], pa.int64()) for j in range(3)), pa.array(digests),
                pa.array(bases, pa.list_(span)), pa.array(weaks, pa.list_(span))
            ],
            ["doc_id", "row", "n_assign", "n_access", "n_hex", "base_sha256", "base", "weak"],
        )


def link_parts(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """The weak rows of ``parts`` (row, start, kind, end) whose complementary parts lie within ``reach``.

    Interval join by tiles: each part is filed under the tiles that its scope touches and meets the
    parts that begin or end in them.
    """
    tile = max(256, 2 * reach)
    role = F.when(F.col("kind").isin(1, 3), "A").when(F.col("kind").isin(0, 2, 4), "S").otherwise("E")
    parts = parts.withColumn("role", role)
    scope = parts.where("kind >= 3").withColumn("tile", F.explode(F.expr(f"sequence((start - {reach}) div {tile} - 1, (end + {reach}) div {tile})")))
    near = parts.withColumn("tile", F.explode(F.array_distinct(F.array(F.expr(f"start div {tile}"), F.expr(f"(end - 1) div {tile}")))))

    def with_role(weak: DataFrame, wanted: str) -> DataFrame:
        other = near.where(F.col("role") == wanted)
        meets = (F.col("w.row") == F.col("p.row")) & (F.col("w.tile") == F.col("p.tile")) & (F.col("p.start") < F.col("w.end") + reach) & (F.col("p.end") > F.col("w.start") - reach)
        return weak.alias("w").join(other.alias("p"), meets, "left_semi").drop("tile").distinct()

    def again(found: DataFrame) -> DataFrame:
        return found.withColumn("tile", F.explode(F.expr(f"sequence((start - {reach}) div {tile} - 1, (end + {reach}) div {tile})")))

    secrets = with_role(scope.where("role = 'S'"), "A")
    identifiers = with_role(scope.where("role = 'A'"), "S")
    endpoints = with_role(again(with_role(scope.where("role = 'E'"), "A")), "S")
    return secrets.unionByName(identifiers).unionByName(endpoints).select("row", "start", "kind", "end")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and found (array of start, kind, end), one row per row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    span = "array<struct<start:int,kind:int,end:int>>"
    scanned = C.staged(rows.mapInArrow(_scan, f"doc_id long, row long, n_assign long, n_access long, n_hex long, base_sha256 string, base {span}, weak {span}"), "scanned")
    some = scanned.where(F.size("weak") > 0)
    parts = some.select("row", F.inline(F.concat("base", "weak")))
    linked = link_parts(parts, reach).groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked"))
    names = F.array(*map(F.lit, KINDS))
    found = F.array_sort(F.concat("base", F.coalesce("linked", F.array().cast(span))))
    joined = scanned.join(linked, "row", "left").withColumn("found", found)
    text = F.array_join(F.transform("found", lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
    return joined.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", text.alias("spans"), "found")


def _redact(spans_col: str):
    """Each batch without its spans and with its text redacted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column(spans_col).to_pylist()):
                pieces, at = [], 0
                for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
                    if s["end"] <= at:
                        continue
                    if s["start"] >= at:
                        pieces += [text[at : s["start"]], f"[{KINDS[s['kind']]}]"]
                    at = s["end"]
                out.append("".join(pieces) + text[at:] if pieces else text)
            names = [c for c in batch.schema.names if c != spans_col]
            yield pa.record_batch([pa.array(out, pa.string()) if c == "text" else batch.column(c) for c in names], names)

    return run


def redact(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """The rows of a documents table (doc_id, text, n_chars and any others) with every span replaced by its kind in brackets.

    A null text stays null. The weak candidates' join needs rows by number, so the rows are written once.
    """
    columns, row, spans = docs.columns, C.new_name(docs, "row"), C.new_name(docs, "spans")
    numbered = C.staged(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = scan(numbered.where("text is not null"), row, "text", reach).where(F.size("found") > 0).select(F.col("doc_id").alias(row), F.col("found").alias(spans))
    joined = numbered.join(C.staged(found, "found"), row, "left")
    clean = joined.where(F.isnull(spans)).select(*columns)
    shape = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    dirty = joined.where(F.isnotnull(spans)).select(*columns, spans).mapInArrow(_redact(spans), shape)
    if "n_chars" in columns:
        dirty = dirty.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return clean.unionByName(dirty.select(*columns))


def op8_secret_scans(spark, sf_dir):
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("found")


QUERIES = {"op8_secret_scans": op8_secret_scans}
ORACLE: dict[str, str] = {}
