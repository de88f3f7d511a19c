"""Operators that depend on row order: running values, lags, first and last rows, numbering, sorting."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rules import as_list, existing, need_order, sort_key
from .scan import Running, scan
from .storage import staged


def dealt(df: DataFrame, keys) -> DataFrame:
    """``df`` in ranges of ``keys``, written once, with the number of each row's range in ``__part``."""
    return staged(df.repartitionByRange(*as_list(keys)).withColumn("__part", F.spark_partition_id()), "dealt")


def running_sums(df: DataFrame, by, at: str, sums: dict[str, str], descending: bool = False) -> DataFrame:
    """``df`` (from ``dealt`` by ``by`` and ``at``, which tell its rows apart) with running sums, name → column, along ``at`` in each BY group.

    Each range is summed by itself; the ranges before it count by one row a range, so no task holds a group. Null levels are a group.
    """
    by, turn = as_list(by), F.desc if descending else F.asc
    inside = Window.partitionBy("__part", *by).orderBy(turn(at)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*by).orderBy(turn("__part")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = df.groupBy("__part", *by).agg(*[F.sum(c).alias(f"__s_{n}") for n, c in sums.items()])
    before = sizes.select(
        F.col("__part").alias("__p"), *[F.col(b).alias(f"__b{i}") for i, b in enumerate(by)],
        *[F.coalesce(F.sum(f"__s_{n}").over(earlier), F.lit(0)).alias(f"__a_{n}") for n in sums]
    )
    same = reduce(and_, [F.col(b).eqNullSafe(F.col(f"__b{i}")) for i, b in enumerate(by)], F.col("__part") == F.col("__p"))
    return df.join(before, same).select(*df.columns, *[(F.col(f"__a_{n}") + F.sum(c).over(inside)).alias(n) for n, c in sums.items()])


def retain_sum(df: DataFrame, x, by, order_by, init: float = 0, name: str = "total") -> DataFrame:
    """Running total from ``init``; nulls add nothing."""
    return scan(df, by, order_by, {name: Running("sum", x)}).withColumn(name, F.lit(init) + F.coalesce(name, F.lit(0)))


def carry_forward(df: DataFrame, x: str, by, order_by, name: str) -> DataFrame:
    """The last value seen that is not null."""
    return scan(df, by, order_by, {name: Running("last", x)})


def carry_backward(df: DataFrame, x: str, by, order_by, name: str) -> DataFrame:
    """The next value that is not null: the last one seen from the end, so that each row is visited once."""
    return scan(df, by, order_by, behind={name: Running("last", x)})


def running(df: DataFrame, x: str, by, order_by, low: str = "low", high: str = "high") -> DataFrame:
    """Running minimum and maximum."""
    return scan(df, by, order_by, {low: Running("min", x), high: Running("max", x)})


def lag(df: DataFrame, x: str, by, order_by, n: int = 1, name: str = "lag") -> DataFrame:
    return scan(df, by, order_by, {name: Running("lag", x, n)})


def dif(df: DataFrame, x: str, by, order_by, n: int = 1, name: str = "dif") -> DataFrame:
    return scan(df, by, order_by, {"__lag": Running("lag", x, n)}).withColumn(name, F.col(x) - F.col("__lag")).drop("__lag")


def first_last(df: DataFrame, by, order_by) -> DataFrame:
    """Flags is_first and is_last (0/1) within each BY group."""
    out = scan(df, by, order_by, {"is_first": Running("lag", F.lit(1))}, {"is_last": Running("lag", F.lit(1))})
    return out.withColumns({c: F.isnull(c).cast("int") for c in ("is_first", "is_last")})


def sequence_in(df: DataFrame, by, order_by, name: str = "seq") -> DataFrame:
    """1, 2, 3, … within each BY group."""
    return scan(df, by, order_by, {name: Running("sum", F.lit(1))})


def row_n(df: DataFrame, order_by, name: str = "_n_") -> DataFrame:
    """1, 2, 3, … over the whole table in a stated order, without one task that holds it.

    Rows are dealt into ranges of the order and numbered inside each; the numbered ranges are written
    once, so that both readings agree, and the ranges' sizes, one row each, are summed and joined back.
    """
    keys = need_order(order_by)
    dealt = df.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id())
    inside = staged(dealt.withColumn("__at", F.row_number().over(Window.partitionBy("__part").orderBy(*keys))), "numbered")
    sizes = inside.groupBy("__part").agg(F.max("__at").alias("__size"))  # as many rows as partitions
    before = sizes.select(F.col("__part").alias("__p"), (F.sum("__size").over(Window.orderBy("__part")) - F.col("__size")).alias("__before"))
    out = inside.join(F.broadcast(before), F.col("__part") == F.col("__p"))
    return out.withColumn(name, (F.col("__at") + F.col("__before")).cast("long")).drop("__part", "__at", "__p", "__before")


def interpolate(df: DataFrame, x: str, at: str, by, name: str) -> DataFrame:
    """Linear interpolation between the neighbours along numeric ``at`` that have a value."""
    known = F.when(F.col(x).isNotNull(), F.struct(F.col(at).alias("t"), F.col(x).alias("x")))
    out = scan(df, by, at, {"__up": Running("last", known)}, {"__down": Running("last", known)})
    x0, x1, t0, t1 = F.col("__up.x"), F.col("__down.x"), F.col("__up.t"), F.col("__down.t")
    return out.withColumn(name, F.coalesce(F.col(x), x0 + (x1 - x0) * (F.col(at) - t0) / (t1 - t0))).drop("__up", "__down")


def sort(df: DataFrame, keys, sas_order: bool = False) -> DataFrame:
    """Ordered rows: names or (name, descending); unknown names are passed over, nulls come last."""
    have = {c.lower() for c in df.columns}
    used = [k for k in as_list(keys) if isinstance(k, Column) or (k if isinstance(k, str) else k[0]).lower() in have]
    return df.orderBy(*[sort_key(k, sas_order) for k in used]) if used else df


def first_k(df: DataFrame, k: int, order_by) -> DataFrame:
    return df.orderBy(*need_order(order_by)).limit(k)


def dedup(df: DataFrame, keys=None, order_by=None) -> DataFrame:
    """Distinct rows; with ``keys`` the first row of each key in a stated order."""
    if keys is None:
        return df.dropDuplicates()
    w = Window.partitionBy(*existing(df, as_list(keys))).orderBy(*need_order(order_by))
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
