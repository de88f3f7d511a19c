"""Exact quantiles and modes of groups of any size.

Equal values are counted before the shuffle, the counted values are dealt into ranges of their order,
and only the ranges that hold a wanted rank are sorted. No task holds a group, hot or not.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import staged


def _keyed(df: DataFrame, by: list[str]) -> tuple[list[Column], list[str]]:
    names = [f"__k{i}" for i in range(len(by))]
    return [F.col(b).alias(k) for b, k in zip(by, names)], names


def _quantiles(df: DataFrame, vars: list[str], probs: list[float], by: list[str]) -> DataFrame:
    """__k0, __k1, … (the levels of ``by``), __v (the variable), __q (its quantiles, interpolated between the two nearest ranks)."""
    keys, names = _keyed(df, by)
    each = F.inline(F.array(*[F.struct(F.lit(v).alias("__v"), F.col(v).cast("double").alias("__x")) for v in vars]))
    group = [*names, "__v"]
    counted = df.select(*keys, each).where("__x is not null").groupBy(*group, "__x").agg(F.count(F.lit(1)).alias("__n"))
    dealt = staged(counted.repartitionByRange(*group, "__x").withColumn("__part", F.spark_partition_id()), "counted")
    sizes = dealt.groupBy("__part", *group).agg(F.sum("__n").alias("__size"))  # a group has as many rows as partitions at most
    w = Window.partitionBy(*group)
    ahead = sizes.withColumns({"__before": F.sum("__size").over(w.orderBy("__part")) - F.col("__size"), "__all": F.sum("__size").over(w)})
    at = [F.lit(p) * (F.col("__all") - 1) for p in probs]
    ranks = [r for h in at for r in (F.floor(h), F.ceil(h))]
    held = ahead.where(reduce(or_, [(r >= F.col("__before")) & (r < F.col("__before") + F.col("__size")) for r in ranks]))
    held = held.select(F.col("__part").alias("__p"), *[F.col(k).alias(f"{k}_h") for k in group], "__before", "__all")
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"{k}_h")) for k in group], F.col("__part") == F.col("__p"))
    met = dealt.join(held, same).select("__part", *group, "__x", "__n", "__before", "__all")
    upto = met.withColumn("__upto", F.col("__before") + F.sum("__n").over(Window.partitionBy("__part", *group).orderBy("__x")))
    value = lambda r: F.max(F.when((r < F.col("__upto")) & (r >= F.col("__upto") - F.col("__n")), F.col("__x")))
    found = upto.groupBy(*group, "__all").agg(*[value(r).alias(f"__r{i}") for i, r in enumerate(ranks)])
    # equal neighbours are returned as they are: their difference is undefined where both are infinite
    q = [F.when(F.col(f"__r{2 * i}") == F.col(f"__r{2 * i + 1}"), F.col(f"__r{2 * i}")).otherwise((F.ceil(h) - h) * F.col(f"__r{2 * i}") + (h - F.floor(h)) * F.col(f"__r{2 * i + 1}")) for i, h in enumerate(at)]
    return found.select(*group, F.array(*q).alias("__q"))


def _modes(df: DataFrame, var: str, name: str, by: list[str]) -> DataFrame:
    """The most frequent value of each group, of several the smallest."""
    keys, names = _keyed(df, by)
    counts = df.select(*keys, F.col(var).alias("__x")).where("__x is not null").groupBy(*names, "__x").agg((-F.count(F.lit(1))).alias("__n"))
    return counts.groupBy(*names).agg(F.min(F.struct("__n", "__x"))["__x"].alias(name))


def add_order_stats(base: DataFrame, df: DataFrame, by: list[str], wants: dict[str, tuple[str, float | str]]) -> DataFrame:
    """``base`` (a row for each group of ``df``, with the columns ``by``) with the wanted columns.

    ``wants``: name → (variable, a share from 0 to 1 or "mode"). Null levels are groups of their own; a group
    without a value gets null.
    """
    parts, names = [], [f"__k{i}" for i in range(len(by))]
    shares = {n: (v, s) for n, (v, s) in wants.items() if s != "mode"}
    if shares:
        vars, probs = (list(dict.fromkeys(x)) for x in zip(*shares.values()))
        found = _quantiles(df, vars, probs, by)
        parts.append(found.groupBy(*names).agg(*[F.max(F.when(F.col("__v") == v, F.col("__q")[probs.index(s)])).alias(n) for n, (v, s) in shares.items()]))
    parts += [_modes(df, v, n, by) for n, (v, s) in wants.items() if s == "mode"]
    for part in parts:
        match = reduce(and_, [base[b].eqNullSafe(part[k]) for b, k in zip(by, names)], F.lit(True))
        base = base.join(part, match, "left").drop(*names)
    return base
