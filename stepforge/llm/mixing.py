"""Operator 13: mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in shuffled order, served again from the start as often as the cap
allows. A document's virtual finish time is the cumulative words of its queue, with it, divided by the
source's target: all queues that are served in order of finish times advance in proportion to their targets.
The finish times are range-sorted over all sources, the words summed along the ranges, and the schedule is
cut at the total budget, within the last piece.

Documents longer than ``precision`` of their source's target are served in pieces of that length, so each
source comes within that share of its target at every size, and a source adds pieces in proportion to
1 / precision at most. A source's served words are a prefix of its queue, so what a document gives follows
from one sum a source; no row travels back. Queues of any size are summed by ranges, and so are the lists
of sources: nothing but written tables of one row a source meets the documents.

Targets: sources, ordered by code point with null last, take the weights in turn and share ``share`` of all
words; a target stops at ``cap`` times its source's words, and the excess goes to the others by weight.
Sorted by cap over weight, the sources that stop are a prefix, which running sums find without rounds.

Defined cases: a null or blank text has size 0 and gives nothing; a source without words has target 0; rows
that are equal throughout are served one after the other and may change places; a null source is a source;
an empty table gives no rows; other columns, whatever their names, do not enter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scan import Running, scan
from . import common as C

WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2
#: The longest piece served at once, as a share of the source's target.
PRECISION = 1e-3
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """source, source_size, rank, target and budget (the same in all rows) from source and source_size."""
    ranked = scan(sizes, [], [F.col("source").asc_nulls_last()], {"rank": Running("sum", F.lit(1))}, by_ranges=True)
    weight = F.array(*[F.lit(float(w)) for w in weights])[F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int")]
    held = C.staged(ranked.withColumn("weight", weight).withColumn("most", cap * F.col("source_size")), "ranked")
    total = held.agg((share * F.sum("source_size")).alias("budget"), F.sum("weight").alias("weights"))
    along = scan(held, [], [(F.col("most") / F.col("weight")).asc(), F.col("rank").asc()], {"mosts": Running("sum", "most"), "weighed": Running("sum", "weight")}, by_ranges=True)
    left = (F.col("budget") - (F.col("mosts") - F.col("most"))) / (F.col("weights") - (F.col("weighed") - F.col("weight")))
    level = along.crossJoin(F.broadcast(total)).withColumn("level", left)  # one row
    stops = F.col("most") <= F.col("level") * F.col("weight")
    level = C.staged(level.withColumn("stops", stops), "levels")
    final = level.where("not stops").agg(F.min_by("level", F.struct(F.col("most") / F.col("weight"), "rank")).alias("final"))
    reached = F.when(F.col("stops"), F.col("most").cast("double")).otherwise(F.col("final") * F.col("weight"))
    return level.crossJoin(F.broadcast(final)).select("source", "source_size", "rank", reached.alias("target"), "budget")


def _served(upto: Column, size: Column, done: Column) -> Column:
    """Words of a queue's first ``done`` that lie in the document ending at ``upto``."""
    return F.greatest(F.lit(0), F.least(size, done - (upto - size))).cast("long")


def queues(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, source, size and upto (the words of the source's queue up to and with it) of every document, in an order shuffled by a hash of id and text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), text).cast("binary")), 1, 16)
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), key.alias("key"))
    rows = C.staged(rows, "sizes")
    return C.staged(scan(rows, "source", ["key", "id", "size"], {"upto": Running("sum", "size")}, by_ranges=True).drop("key"), "queues")


def schedule(queued: DataFrame, aims: DataFrame, cap: int = CAP, precision: float = PRECISION) -> DataFrame:
    """The mix in its order: id, source, start (the piece's first word in its document), words taken, finish (virtual) and place (words of the mix before it)."""
    t = aims.select(F.col("source").alias("of"), "source_size", "rank", "target", "budget")
    rows = queued.where("size > 0").join(t, F.col("source").eqNullSafe(F.col("of"))).where("target > 0")
    longest = F.greatest(F.lit(1).cast("long"), F.floor(precision * F.col("target")))
    turns = F.sequence(F.lit(0), (F.least(F.lit(cap), F.ceil(F.col("target") / F.col("source_size"))) - 1).cast("int"))
    rows = rows.withColumn("longest", longest).withColumn("turn", F.explode(turns))
    rows = rows.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.col("longest"))))
    words = F.least(F.col("longest"), F.col("size") - F.col("start"))
    finish = (F.col("turn") * F.col("source_size") + F.col("upto") - F.col("size") + F.col("start") + F.col("words")) / F.col("target")
    pieces = rows.withColumn("words", words).withColumn("finish", finish).select("id", "source", "start", "words", "finish", "rank", "budget")
    placed = scan(pieces, [], ["finish", "rank"], {"through": Running("sum", "words")}, by_ranges=True)
    place = F.col("through") - F.col("words")
    return placed.withColumn("place", place).withColumn("words", F.least(F.col("words"), F.floor("budget") - place)).where("words > 0").drop("through", "budget")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, cap: int = CAP,
    precision: float = PRECISION
) -> DataFrame:
    """id, source, size, source_size, target and taken (words, repeats counted) of every document."""
    queued = queues(docs, id_col, text_col, source_col)
    aims = C.staged(targets(queued.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap), "targets")
    served = schedule(queued, aims, cap, precision).groupBy("source").agg(F.sum("words").alias("done"))
    known = aims.alias("a").join(served.alias("s"), F.expr("a.source <=> s.source"), "left").select(
        F.col("a.source").alias("of"), "source_size", "target", F.coalesce("done", F.lit(0)).alias("done")
    )
    out = queued.join(C.staged(known, "served"), F.col("source").eqNullSafe(F.col("of")))
    taken = sum((_served(F.col("upto") + turn * F.col("source_size"), F.col("size"), F.col("done")) for turn in range(1, cap)), _served(F.col("upto"), F.col("size"), F.col("done")))
    return out.select("id", "source", "size", "source_size", "target", taken.alias("taken"))


def op13_mix_sources(spark, sf_dir):
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id").drop("source")


QUERIES = {"op13_mix_sources": op13_mix_sources}

ORACLE = {
    "op13_mix_sources": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  left(md5(coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || coalesce(text, '')), 16) AS key FROM documents),
q AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size, r ROWS UNBOUNDED PRECEDING) AS upto FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][(rank - 1) % {len(WEIGHTS)} + 1] AS weight, {CAP} * source_size AS most FROM s),
l AS (SELECT *, ({SHARE} * sum(source_size) OVER () - (sum(most) OVER o - most)) / (sum(weight) OVER () - (sum(weight) OVER o - weight)) AS level, {SHARE} * sum(source_size) OVER () AS budget,
             row_number() OVER o AS turn FROM w WINDOW o AS (ORDER BY most / weight, rank ROWS UNBOUNDED PRECEDING)),
a AS (SELECT source, source_size, rank, budget, CAST(CASE WHEN most <= level * weight THEN most ELSE (SELECT arg_min(level, turn) FROM l WHERE most > level * weight) * weight END AS DOUBLE) AS target FROM l),
p AS (SELECT q.*, source_size, rank, budget, target, greatest(1, CAST(floor({PRECISION} * target) AS BIGINT)) AS longest, unnest(range(CAST(least({CAP}, ceil(target / source_size)) AS BIGINT))) AS turn
      FROM q JOIN a ON q.source IS NOT DISTINCT FROM a.source WHERE size > 0 AND target > 0),
i AS (SELECT *, unnest(range(0, size, longest)) AS start FROM p),
f AS (SELECT r, rank, budget, least(longest, size - start) AS words, (turn * source_size + upto - size + start + least(longest, size - start)) / target AS finish FROM i),
c AS (SELECT r, words, floor(budget) - (sum(words) OVER (ORDER BY finish, rank ROWS UNBOUNDED PRECEDING) - words) AS left_over FROM f),
t AS (SELECT r, sum(least(words, left_over)) AS taken FROM c WHERE left_over > 0 GROUP BY r)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM q JOIN a ON q.source IS NOT DISTINCT FROM a.source LEFT JOIN t USING (r)"""
}
