"""Pairs of similar names without comparing every name with every other.

Candidates come from inverted indexes whose keys any pair over the limit must share, so none is lost:
equal names by themselves; a name held by another by the rarest of its three-letter pieces; names that
share enough letters by a pair of letters (or one letter) among the rarest of the probing name, at each
length that the other may have. What the indexes propose is then compared by the definition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import staged

#: Letters whose frequency decides the order of probing; all others count as rarer.
COMMON = 200


def _shared(a: Column, b: Column) -> Column:
    """How many letters of a occur in b."""
    return F.size(F.filter(F.split(a, ""), lambda c: (c != "") & F.contains(b, c)))


def similarity(a: Column, b: Column, longer: str = "swap") -> Column:
    """1 if equal, 0.85 if one holds the other, else the share of letters in common.

    "swap" counts the shorter name's letters in the longer one (the first name counts as the shorter
    of two equally long ones), "first" the first name's letters in the second.
    """
    a, b = F.lower(a), F.lower(b)
    if longer == "swap":
        hits = F.when(F.length(a) > F.length(b), _shared(b, a)).otherwise(_shared(a, b))
    else:
        hits = _shared(a, b)
    return F.when(a == b, 1.0).when(F.contains(b, a) | F.contains(a, b), 0.85).otherwise(F.try_divide(hits.cast("double"), F.greatest(F.length(a), F.length(b))))


def _pieces(name: Column, n: int) -> Column:
    """All pieces of n letters."""
    return F.transform(F.sequence(F.lit(1), F.length(name) - (n - 1)), lambda i: F.substring(name, i, F.lit(n)))


def held_pairs(parts: DataFrame, wholes: DataFrame) -> DataFrame:
    """part, whole: which names of ``parts`` (part) are held by names of ``wholes`` (whole), both distinct."""
    w, p = F.col("whole"), F.col("part")
    every = F.concat(F.array(F.lit("")), *[F.when(F.length(w) >= n, _pieces(w, n)).otherwise(F.array().cast("array<string>")) for n in (1, 2, 3)])
    index = staged(wholes.select(w, F.explode(F.array_distinct(every)).alias("piece")), "pieces")
    counts = index.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    own = F.when(F.length(p) == 0, F.array(F.lit(""))).when(F.length(p) == 1, F.array(p)).when(F.length(p) == 2, F.array(p)).otherwise(_pieces(p, 3))
    probes = parts.select(p, F.explode(F.array_distinct(own)).alias("piece")).join(counts, "piece", "left")
    # a piece that no name has rules the part out
    rarest = probes.groupBy("part").agg(F.min_by("piece", "n").alias("piece"), F.count_if(F.isnull("n")).alias("none")).where("none = 0")
    return rarest.join(index, "piece").where(F.contains(w, p)).select("part", "whole")


def _letters(name: Column, common: list[str]) -> Column:
    """The letters of a name, repeated ones too, rarest first."""
    place = lambda c: F.array_position(F.array(*map(F.lit, common)).cast("array<string>"), c)
    held = F.filter(F.split(name, ""), lambda c: c != "")
    ranked = F.transform(held, lambda c: F.struct(F.when(place(c) == 0, -COMMON - 1).otherwise(-place(c)).alias("k"), c.alias("c")))
    return F.transform(F.sort_array(ranked), lambda s: s["c"])


def _pairs(letters: Column, same: bool) -> Column:
    """Two letters each as one key, in either order alike: of two different places, or (``same``) of any two letters and each with itself."""
    after = lambda i: F.slice(letters, i + (1 if same else 2), F.size(letters))
    both = F.transform(letters, lambda x, i: F.transform(after(i), lambda y: F.concat(F.least(x, y), F.greatest(x, y))))
    return F.array_distinct(F.flatten(both))


def _sharing(probe: DataFrame, other: DataFrame, least: float, longest: bool) -> DataFrame:
    """p, o: candidates among which are all pairs where over ``least`` times the longer length of p's letters occur in o.

    ``longest``: only pairs where o is at least as long as p. Of a name's letters all but need - 2 hold two that
    the other has, if the other has need of them.
    """
    spread = other.select("o", F.array_distinct(F.filter(F.split("o", ""), lambda c: c != "")).alias("letters"))
    common = [r[0] for r in spread.select(F.explode("letters").alias("c")).groupBy("c").count().orderBy(F.desc("count"), "c").limit(COMMON).collect()]
    index = spread.select(
        "o", F.length("o").alias("size"),
        F.explode(F.concat(F.transform("letters", lambda c: F.concat(F.lit("1"), c)), F.transform(_pairs(F.col("letters"), True), lambda k: F.concat(F.lit("2"), k)))).alias("key")
    )
    sizes = index.select("size").distinct().withColumnRenamed("size", "at")
    n = F.length("p")
    # hits <= n, so the longer length lies below n / least
    most = F.floor(n / F.lit(max(least, 1e-9))).cast("int") if least > 0 else F.lit(1 << 20)
    known = sizes.agg(F.max("at").alias("top"))
    probes = probe.select("p", _letters(F.col("p"), common).alias("letters")).join(F.broadcast(known), F.col("top") >= 0).where(n > 0)  # one row
    low = n if longest else F.lit(1)
    probes = probes.withColumn("size", F.explode(F.when(F.least(most, "top") >= low, F.sequence(low, F.least(most, "top")))))
    need = F.greatest(F.lit(1), (F.floor(least * F.greatest(n, "size") - 1e-9) + 1).cast("int"))
    probes = probes.withColumn("need", need).where(F.col("need") <= n)
    two = F.transform(_pairs(F.slice("letters", F.lit(1), n - F.col("need") + 2), False), lambda k: F.concat(F.lit("2"), k))
    one = F.transform(F.array_distinct("letters"), lambda c: F.concat(F.lit("1"), c))
    keys = probes.select("p", "size", F.explode(F.when(F.col("need") >= 2, two).otherwise(one)).alias("key"))
    return keys.join(index, ["size", "key"]).select("p", "o").distinct()


def similar_pairs(left: DataFrame, right: DataFrame, least: float, longer: str = "swap") -> DataFrame:
    """a, b, score: pairs of names, one of ``left`` (a) and one of ``right`` (b), whose similarity is over ``least``.

    Both hold distinct names in lower case without nulls; ``least`` is 0 or more.
    """
    if least < 0:
        raise ValueError("below 0 every pair is similar")
    left, right = staged(left.select("a"), "left"), staged(right.select("b"), "right")
    a, b = left.withColumnRenamed("a", "p"), right.withColumnRenamed("b", "o")
    found = [left.join(right, F.col("a") == F.col("b"))]
    if least < 0.85:
        found.append(held_pairs(left.withColumnRenamed("a", "part"), right.withColumnRenamed("b", "whole")).select(F.col("part").alias("a"), F.col("whole").alias("b")))
        found.append(held_pairs(right.withColumnRenamed("b", "part"), left.withColumnRenamed("a", "whole")).select(F.col("whole").alias("a"), F.col("part").alias("b")))
    found.append(_sharing(a, b, least, longer == "swap").select(F.col("p").alias("a"), F.col("o").alias("b")))
    if longer == "swap":  # the shorter name probes
        found.append(_sharing(b.withColumnRenamed("o", "p"), a.withColumnRenamed("p", "o"), least, True).select(F.col("o").alias("a"), F.col("p").alias("b")))
    pairs = reduce(DataFrame.unionByName, found).distinct()
    return pairs.withColumn("score", similarity(F.col("a"), F.col("b"), longer)).where(F.col("score") > least)
