"""Merges, look-ups, updates, unions and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rules import as_list


def unique_rows(df: DataFrame, by, cols: list[str] | None = None) -> DataFrame:
    """The key columns and ``cols`` (all others) of ``df``; a key with more than one row fails the job that meets it.

    The check is part of the plan: nothing runs before the action, and the aggregate by key, which combines before
    its exchange, deals the rows as a join on the key needs them.
    """
    by = as_list(by)
    cols = [c for c in df.columns if c not in by] if cols is None else cols
    row = F.struct(F.lit(1).alias("__n"), *[F.col(c) for c in cols])
    one = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__count"), F.first(row).alias("__row"))
    checked = F.when(F.col("__count") == 1, F.col("__row")).otherwise(F.raise_error(f"more than one row for a key of {by}").cast(one.schema["__row"].dataType))
    return one.select(*by, checked.alias("__row")).select(*by, *[F.col("__row")[c].alias(c) for c in cols])


def merge(
    a: DataFrame, b: DataFrame, by, how: str = "left", keep_if: str | None = None, overlay: bool = True, flags: tuple[str, str] | None = None,
    validate: str | None = None
) -> DataFrame:
    """MERGE a b; BY ….

    ``keep_if``: "a", "b", "a and b", "not b" (rows of a alone), "not a", as the IN= subsetting IF does.
    Shared columns: the later table wins on matched rows; without ``overlay`` they get .x and .y.
    ``validate``: "1:m" or "m:1", the side whose keys must be unique; a double key fails the job that meets it.
    ``flags``: names of 0/1 columns that say which side a row came from.
    """
    by = as_list(by)
    if validate == "1:m":
        a = unique_rows(a, by).select(*a.columns)
    elif validate == "m:1":
        b = unique_rows(b, by).select(*b.columns)
    if keep_if == "not b":
        return a.join(b, by, "left_anti")
    if keep_if == "not a":
        return b.join(a, by, "left_anti")
    how = {"a": "left", "b": "right", "a and b": "inner"}.get(keep_if, how)
    shared = [c for c in a.columns if c in b.columns and c not in by]
    left, right = a.withColumn("__a", F.lit(1)), b.withColumn("__b", F.lit(1))
    right = right.withColumnsRenamed({c: f"__r_{c}" for c in shared})
    out = left.join(right, by, how)
    cols = []
    for c in [*by, *[c for c in a.columns if c not in by]]:
        if c not in shared:
            cols.append(F.col(c))
        elif overlay:
            cols.append(F.when(F.col("__b").isNotNull(), F.col(f"__r_{c}")).otherwise(F.col(c)).alias(c))
        else:
            cols += [F.col(c).alias(f"{c}.x"), F.col(f"__r_{c}").alias(f"{c}.y")]
    cols += [F.col(c) for c in b.columns if c not in by and c not in shared]
    if flags:
        cols += [F.coalesce("__a", F.lit(0)).alias(flags[0]), F.coalesce("__b", F.lit(0)).alias(flags[1])]
    return out.select(*cols)


def merge_all(frames: list[DataFrame], by, how: str = "left") -> DataFrame:
    """MERGE of many tables, from left to right."""
    return reduce(lambda a, b: merge(a, b, by, how), frames)


def sql_join(a: DataFrame, b: DataFrame, on: list[tuple[str, str]], how: str = "inner", select: list | None = None, where=None) -> DataFrame:
    """JOIN … ON with key names that may differ; columns of both sides under aliases a and b."""
    cond = reduce(lambda x, y: x & y, [F.col(f"a.{l}") == F.col(f"b.{r}") for l, r in on])
    out = a.alias("a").join(b.alias("b"), cond, how)
    out = out.where(where) if where is not None else out
    return out.select(*select) if select else out


def lookup(df: DataFrame, ref: DataFrame, key, cols: list[str]) -> DataFrame:
    """Columns of a reference table by key; one row per key is enforced, unknown keys give nulls.

    Spark broadcasts the reference where its size is known to be small, and shuffles both sides otherwise.
    """
    key = as_list(key)
    return df.join(unique_rows(ref, key, cols), key, "left")


def update(master: DataFrame, trans: DataFrame, by) -> DataFrame:
    """UPDATE: values that are not missing replace the master's; unmatched transactions are added."""
    return _overwrite(master, trans, as_list(by), "full")


def modify(master: DataFrame, trans: DataFrame, by) -> DataFrame:
    """MODIFY: as update, matched rows only."""
    return _overwrite(master, trans, as_list(by), "left")


def _overwrite(master: DataFrame, trans: DataFrame, by: list[str], how: str) -> DataFrame:
    both = [c for c in master.columns if c in trans.columns and c not in by]
    t = trans.select(*by, *[F.col(c).alias(f"__t_{c}") for c in both])
    out = master.join(t, by, how)
    return out.select(*[F.coalesce(f"__t_{c}", c).alias(c) if c in both else F.col(c) for c in master.columns])


def orphans(child: DataFrame, parent: DataFrame, keys) -> DataFrame:
    """Child rows without a parent."""
    return child.join(parent, as_list(keys), "left_anti")


def integrity_score(child: DataFrame, parent: DataFrame, keys) -> DataFrame:
    """total, matched and score (percent) of child rows that have a parent."""
    keys = as_list(keys)
    known = parent.select(*keys).distinct().withColumn("__p", F.lit(1))
    out = child.join(known, keys, "left").agg(F.count(F.lit(1)).alias("total"), F.count("__p").alias("matched"))
    return out.withColumn("score", F.round(F.try_divide(100.0 * F.col("matched"), "total"), 4))


def set_(*frames: DataFrame) -> DataFrame:
    """SET: rows of all tables, columns by name, absent ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def difference(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    """Keys of a that b has not."""
    keys = as_list(keys)
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), keys, "left_anti")


def intersection(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    """Keys that both have."""
    keys = as_list(keys)
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), keys, "left_semi")
