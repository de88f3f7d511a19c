"""Language-model scores by prediction by partial matching.

The model sees a text as its lower-cased (A-Z) words joined by single spaces and one end mark. Its
trie holds, for contexts of 0 to ``order`` bytes, how often each next byte follows in the training
documents. Escape is method C: a context with total T and d distinct bytes gives n / (T + d) to a
byte seen n times and d / (T + d) to the escape, after which the next shorter context predicts
without the bytes already excluded. What follows a context also follows its suffix, so the
exclusions of a level are exactly the bytes of the level above, and each context's reduced total
is a constant: the probability of a byte is a function of it and the ``order`` bytes before it.

Counts are Spark aggregates over all training documents, and every counted entry is kept, with
totals over all of a context's entries, in tables that never leave Spark. Only the ``TABLE`` most
frequent byte strings are broadcast, with their probabilities; each text lists its other byte
strings, and their distinct values meet the tables in joins, as do the contexts to which unseen
ones escape. Likewise the words that make up at least 1 / ``SHARE`` of all tokens are broadcast
for the base score, and all other words meet their counts in a join.

Defined results: a null or blank text is its end mark alone; a null doc_id is folded as the empty
text, hence trains; rows are kept one for one; other columns are ignored; without training
documents every count is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

ORDER = 5
SHARE = 1 << 22
#: Byte strings whose probabilities are broadcast; all others are joined.
TABLE = 1 << 19
END = np.uint64(10)  # no word holds a line feed, so it can mark a text's end
END_TOKEN = np.uint64(1)
WORD, GRAM = 0, 1


def fold(id_col: str, parts: int) -> Column:
    """crc32 of an id as text, modulo ``parts``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)) % parts


def normal_form(w: C.Words) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, each its words joined by a space and an end mark; where each text begins, and the end)."""
    sizes = w.ends - w.starts
    n = np.diff(w.first)
    out_len = sizes + 1  # each word is followed by a space, or by the end mark
    empty = n == 0
    begin = np.zeros(len(n) + 1, np.int64)
    np.cumsum(np.where(empty, 1, np.add.reduceat(np.append(out_len, 0), np.minimum(w.first[:-1], len(out_len))) if len(n) else 0), out=begin[1:])
    out = np.full(begin[-1], 32, np.uint8)
    before = np.cumsum(out_len) - out_len
    doc = w.doc_of_word()
    to = before - (before[w.first[doc]] if len(doc) else 0) + begin[doc]
    within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(to, sizes) + within] = w.data[np.repeat(w.starts, sizes) + within]
    out[begin[1:] - 1] = END
    return out, begin


def grams(text: np.ndarray, begin: np.ndarray, order: int) -> np.ndarray:
    """For each byte: it and the ``order`` bytes before it as one number, end marks standing before a text's first byte."""
    since = np.arange(len(text)) - np.repeat(begin[:-1], np.diff(begin))
    out = text.astype(np.uint64)
    for j in range(1, order + 1):
        earlier = np.full(len(text), END, np.uint64)
        earlier[j:] = np.where(since[j:] >= j, text[:-j] if j else text, END)
        out |= earlier << np.uint64(8 * j)
    return out


def _add(held: list, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
    """Add counted keys to ``held`` = [keys, counts], both merged."""
    if counts is None:
        keys, counts = np.unique(keys, return_counts=True)
    if len(held[0]):
        keys, at = np.unique(np.concatenate([held[0], keys]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([held[1], counts]), len(keys)).astype(np.int64)
    held[:] = [keys, counts]


def _count(order: int, most: int = 1 << 20):
    """Rows (kind, key, n): words and byte strings counted over a partition, sent on when there are many."""

    def rows(kind: int, held: list) -> pa.RecordBatch:
        batch = pa.record_batch([pa.array(np.full(len(held[0]), kind, np.int32)), pa.array(held[0].view(np.int64)), pa.array(held[1].astype(np.int64))], ["kind", "key", "n"])
        held[:] = [np.zeros(0, np.uint64), np.zeros(0, np.int64)]
        return batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = [np.zeros(0, np.uint64), np.zeros(0, np.int64)]
        held = {WORD: list(empty), GRAM: list(empty)}
        with np.errstate(over="ignore"):
            for batch in batches:
                for at, to, w in C.word_chunks(batch.column("text"), lower=True):
                    _add(held[WORD], w.hashes())
                    _add(held[WORD], np.array([END_TOKEN]), np.array([to - at]))
                    text, begin = normal_form(w)
                    _add(held[GRAM], grams(text, begin, order))
                    for kind, h in held.items():
                        if len(h[0]) > most:
                            yield rows(kind, h)
        for kind, h in held.items():
            if len(h[0]):
                yield rows(kind, h)

    return run


class Lookup:
    """A fixed set of 64-bit keys; finds the row number of many keys at once (-1: absent)."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(4 * max(1, len(keys)) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.rows = np.full(1 << bits, -1, np.int32)
        self.slots = np.zeros(1 << bits, np.uint64)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.rows[at] < 0
            self.rows[at[free]] = left[free]  # the last writer of a slot has it
            self.slots[at[free]] = keys[left[free]]
            lost = self.rows[at] != left
            left, at = left[lost], (at[lost] + 1) & self.mask
        # a slot may hold a key written before another that lost it; both are rewritten from rows
        used = self.rows >= 0
        self.slots[used] = keys[self.rows[used]]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        out = self.rows[at]
        wrong = np.flatnonzero((out >= 0) & (self.slots[at] != keys))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & self.mask
            now = self.rows[at[wrong]]
            out[wrong] = now
            wrong = wrong[(now >= 0) & (self.slots[at[wrong]] != keys[wrong])]
        return out


def _mask(size: Column) -> Column:
    """The lowest ``size`` bytes (none where negative)."""
    return F.pow(F.lit(256.0), F.greatest(size, F.lit(0))).cast("long") - 1


def _entries(grams: DataFrame, order: int) -> DataFrame:
    """j, key, n: how often each byte follows each context of j bytes; a key is the context and the byte."""
    levels = F.array(*[F.struct(F.lit(j).alias("j"), F.col("key").bitwiseAND(F.lit((1 << 8 * (j + 1)) - 1)).alias("key")) for j in range(order + 1)])
    return grams.select(F.explode(levels).alias("e"), "n").groupBy("e.j", "e.key").agg(F.sum("n").alias("n"))


def _contexts(entries: DataFrame) -> DataFrame:
    """j, context, total, size of every context; room and fresh: total and escape of its suffix without the bytes seen in it."""
    own = entries.select("j", F.shiftright("key", 8).alias("context"), "n", (F.col("j") - 1).alias("i"), F.col("key").bitwiseAND(_mask(F.col("j"))).alias("suffix"))
    shorter = entries.select(F.col("j").alias("i"), F.col("key").alias("suffix"), F.col("n").alias("seen"))
    found = own.join(shorter, ["i", "suffix"], "left").groupBy("j", "context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("size"), F.sum("seen").alias("seen"))
    found = C.staged(found, "totals")
    below = found.select(F.col("j").alias("i"), F.col("context").alias("suffix"), F.col("total").alias("below"), F.col("size").alias("wide"))
    longer = found.withColumns({"i": F.col("j") - 1, "suffix": F.col("context").bitwiseAND(_mask(F.col("j") - 1))}).join(below, ["i", "suffix"], "left")
    fresh = F.greatest(F.col("wide") - F.col("size"), F.lit(1))
    return longer.select("j", "context", "total", "size", (F.col("below") - F.col("seen") + fresh).alias("room"), fresh.alias("fresh"))


def _escaped(keys: DataFrame, model: dict) -> DataFrame:
    """key, v: log10 probability of byte strings that the longest contexts do not hold, by their shorter contexts."""
    order = model["order"]
    levels = F.array(*[F.struct(F.lit(j).alias("j"), F.col("key").bitwiseAND(F.lit((1 << 8 * (j + 1)) - 1)).alias("sub")) for j in range(order + 1)])
    asked = keys.select("key", F.explode(levels).alias("e")).select("key", "e.j", "e.sub", F.shiftright("e.sub", 8).alias("context"))
    entries = model["entries"].select("j", F.col("key").alias("sub"), "n")

    def met(some: Column, hint: str) -> DataFrame:
        return asked.where(some).join(entries.where(some).hint(hint), ["j", "sub"], "left").join(model["contexts"].where(some).hint(hint), ["j", "context"], "left")

    # contexts of one byte or none are met by all: at most 65,792 entries, so they go to the rows
    both = met(F.col("j") > 1, "merge").unionByName(met(F.col("j") <= 1, "broadcast"))
    names = ("n", "total", "size", "room", "fresh")
    wide = both.groupBy("key").agg(*[F.max(F.when(F.col("j") == j, F.col(c))).alias(f"{c}{j}") for j in range(order + 1) for c in names])
    v = F.when(F.col("total0").isNull(), -F.log10(F.lit(256.0))).otherwise(-F.log10(F.greatest(F.lit(256) - F.col("size0"), F.lit(1))))
    for j in range(order + 1):
        room, out = F.col(f"total{j}") + F.col(f"size{j}"), F.col(f"size{j}")
        if j < order:  # the longer context escaped, where it is known
            above = F.col(f"total{j + 1}").isNotNull()
            room, out = F.when(above, F.col(f"room{j + 1}")).otherwise(room), F.when(above, F.col(f"fresh{j + 1}")).otherwise(out)
        v = F.when(F.col(f"n{j}").isNotNull(), F.log10(f"n{j}") - F.log10(room)).otherwise(F.coalesce(F.log10(out) - F.log10(room), F.lit(0.0)) + v)
    return wide.select("key", v.alias("v"))


def learn(docs: DataFrame, text_col: str = "text", order: int = ORDER, share: int | None = None, table: int = TABLE) -> dict:
    """What scoring needs, learnt from all rows of ``docs``: tables of entries and contexts, what is broadcast, and the other words' counts.

    ``share`` asks for a pruned model: entries of contexts of two or more bytes that make up less than 1 / ``share`` of all positions
    are left out. By default none is.
    """
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counted = C.staged(texts.mapInArrow(_count(order), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    total = {r["kind"]: (r["n"], r["v"]) for r in counted.groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    tokens, vocabulary = total.get(WORD, (0, 0))
    positions = total.get(GRAM, (0, 0))[0]

    def arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        found = df.toArrow()  # at most ``table`` byte strings or ``SHARE`` words, by the filter on n
        keys, values = (found.column(c).to_numpy() for c in df.columns)
        at = np.argsort(keys.view(np.uint64))
        return keys.view(np.uint64)[at], values[at]

    entries = _entries(counted.where(F.col("kind") == GRAM), order)
    if share is not None:
        entries = entries.where((F.col("j") <= 1) | (F.col("n") * share >= positions))
    entries = C.staged(entries, "entries")
    contexts = C.staged(_contexts(entries), "contexts")
    longest = entries.where(F.col("j") == order).withColumn("context", F.shiftright("key", 8)).join(contexts.where(F.col("j") == order).select("context", "total", "size"), "context")
    seen = C.staged(longest.select("key", (F.log10("n") - F.log10(F.col("total") + F.col("size"))).alias("v"), F.floor(F.log2("n") * 8).alias("band")), "seen")
    least, room = 1 << 20, table
    for r in seen.groupBy("band").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("band")).collect():  # at most 504 bands
        room -= r["n"]
        if room < 0:
            break
        least = r["band"]
    grams = arrays(seen.where(F.col("band") >= least).select("key", "v"))
    words = counted.where(F.col("kind") == WORD).select("key", "n")
    ends = words.where(F.col("key") == int(END_TOKEN)).agg(F.sum("n")).first()[0] or 0
    frequent = arrays(words.where(F.col("n") * (share or SHARE) >= tokens))
    return {
        "order": order, "tokens": int(tokens or 0), "vocabulary": int(vocabulary or 0), "ends": int(ends), "frequent": (Lookup(frequent[0]), frequent[1]),
        "others": words.where(F.col("n") * (share or SHARE) < tokens), "grams": (Lookup(grams[0]), grams[1]), "seen": seen.where(F.col("band") < least).select("key", "v"),
        "entries": entries, "contexts": contexts,
    }


def _listed(owner: np.ndarray, keys: np.ndarray, docs: int) -> pa.Array:
    """For each text the distinct ones of its keys and how often it holds each."""
    at = np.lexsort((keys, owner))
    owner, keys = owner[at], keys[at]
    new = np.ones(len(keys), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(keys)))
    rows = pa.StructArray.from_arrays([pa.array(keys[first].view(np.int64)), pa.array(times.astype(np.int32))], ["key", "times"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[first], np.arange(docs + 1)).astype(np.int32)), rows)


def _score(shared, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        (find_gram, values), (find, counts), total = model["grams"], model["frequent"], model["tokens"] + model["vocabulary"] + 1
        values, logs = np.append(values, 0.0), np.append(np.log10((counts + 1) / total), 0.0)
        end_log, end_known = np.log10((model["ends"] + 1) / total), int(model["ends"] > 0)
        with np.errstate(over="ignore"):
            for batch in batches:
                for at, to, w in C.word_chunks(batch.column("text"), lower=True):
                    docs = to - at
                    text, begin = normal_form(w)
                    key = grams(text, begin, order)
                    gram = find_gram.find(key)
                    score = np.add.reduceat(values[gram], begin[:-1])
                    far = np.flatnonzero(gram < 0)
                    h, owner = w.hashes(), w.doc_of_word()
                    row = find.find(h)
                    known = np.bincount(owner[row >= 0], minlength=docs) + end_known
                    base = np.bincount(owner, logs[row], docs) + end_log
                    rest = row < 0
                    yield pa.record_batch(
                        [
                            *(batch.column(c).slice(at, docs) for c in ("doc_id", "row", "held_out")), pa.array(np.diff(w.first) + 1), pa.array(known.astype(np.int64)),
                            pa.array(base), pa.array(score), _listed(owner[rest], h[rest], docs), _listed(np.searchsorted(begin, far, "right") - 1, key[far], docs),
                        ],
                        ["doc_id", "row", "held_out", "n_tokens", "known", "base", "score", "others", "grams"],
                    )

    return run


def score_documents(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every row."""
    spark = docs.sparkSession
    held = F.coalesce(held_out if held_out is not None else F.lit(False), F.lit(False))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), held.alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shared = spark.sparkContext.broadcast({k: model[k] for k in ("grams", "frequent", "tokens", "vocabulary", "ends")})
    shape = f"doc_id {dict(rows.dtypes)['doc_id']}, row long, held_out boolean, n_tokens long, known long, base double, score double, others array<struct<key:long,times:int>>, grams array<struct<key:long,times:int>>"
    scored = C.staged(rows.mapInArrow(_score(shared, model["order"]), shape), "scored")
    total = model["tokens"] + model["vocabulary"] + 1
    rare = scored.select("row", F.inline("others")).join(C.staged(model["others"], "others"), "key", "left")
    n = F.coalesce("n", F.lit(0))
    rare = rare.select("row", (F.col("times") * F.log10((n + 1) / F.lit(float(total)))).alias("b"), F.when(n > 0, F.col("times")).otherwise(0).alias("k"), F.lit(0.0).alias("g"))
    listed = scored.select("row", F.inline("grams"))
    unseen = C.staged(listed.select("key").distinct().join(model["seen"].hint("merge"), "key", "left_anti"), "unseen")
    priced = model["seen"].unionByName(C.staged(_escaped(unseen, model), "escaped"))
    far = listed.join(priced.hint("merge"), "key").select("row", F.lit(0.0).alias("b"), F.lit(0).alias("k"), (F.col("times") * F.col("v")).alias("g"))
    sums = rare.unionByName(far).groupBy("row").agg(F.sum("b").alias("b"), F.sum("k").alias("k"), F.sum("g").alias("g"))
    out = scored.drop("others", "grams").join(sums, "row", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(model["tokens"]).cast("long").alias("train_tokens"),
        F.round(F.col("base") + F.coalesce("b", F.lit(0.0)), 6).alias("base_score"), F.round(F.col("score") + F.coalesce("g", F.lit(0.0)), 6).alias("score"),
    )


def op6_lm_scoring(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = fold("doc_id", 7) == 2
    return score_documents(docs, learn(docs.where(~held)), held_out=held)


QUERIES = {"op6_lm_scoring": op6_lm_scoring}
ORACLE: dict[str, str] = {}
