"""Running values in a stated order over groups of any size.

A running value is a fold of an associative state. Rows are dealt into ranges of (BY, order) and written
once; each range is folded by itself. Only the first group of a range can have rows in earlier ranges, so
what flows into a range is one state, folded from the last groups of the ranges before it: the tables of
states have one row a range, and no task holds a group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rules import as_list, need_order
from .storage import staged

#: Groups of at most so many rows are one task's window; a table with a larger one is scanned by ranges.
GROUP_ROWS = 1 << 20


@dataclass(frozen=True)
class Running:
    """One running value: "sum", "min", "max", "last" (the last that is not null) up to and with the row, or "lag" (``n`` rows before it)."""

    kind: str
    value: Column | str
    n: int = 1

    def over(self, w, v: Column) -> Column:
        """The value within the frame's own rows; ``w`` is ordered."""
        upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        if self.kind == "lag":
            return F.lag(v, self.n).over(w)
        return F.last(v, ignorenulls=True).over(upto) if self.kind == "last" else getattr(F, self.kind)(v).over(upto)

    def state(self, v: Column, at: Column, edge: Column) -> Column:
        """What a range's group hands on; ``at`` grows along the scan and ends at ``edge``."""
        if self.kind == "last":
            return F.max_by(v, F.when(v.isNotNull(), at))
        if self.kind == "lag":
            return F.sort_array(F.collect_list(F.when(edge - at < self.n, F.struct(at.alias("at"), v.alias("v")))))
        return getattr(F, self.kind)(v)

    def folded(self, state: Column, w) -> Column:
        """The states of the ranges before, as one; each range has two rows in ``w``, and at least one row of the group."""
        if self.kind == "lag":
            return F.flatten(F.collect_list(state).over(w.rowsBetween(-2 * self.n, -1)))
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        return F.last(state, ignorenulls=True).over(before) if self.kind == "last" else getattr(F, self.kind)(state).over(before)

    def joined(self, carried: Column, own: Column, row: Column) -> Column:
        """The whole value of row number ``row`` of its range's part of the group."""
        if self.kind == "lag":
            return F.when(row > self.n, own).otherwise(F.try_element_at(carried, (row - self.n - 1).cast("int"))["v"])
        if self.kind == "sum":
            return F.coalesce(carried + own, carried, own)
        return F.coalesce(own, carried) if self.kind == "last" else {"min": F.least, "max": F.greatest}[self.kind](carried, own)


def has_hot_group(df: DataFrame, by: list[str], rows: int = GROUP_ROWS) -> bool:
    """Whether a BY group has more than ``rows`` rows; one aggregate that combines before its shuffle and reads the BY columns alone."""
    return (df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) > rows


def scan(df: DataFrame, by, order_by, ahead: dict[str, Running] | None = None, behind: dict[str, Running] | None = None, by_ranges: bool | None = None) -> DataFrame:
    """``df`` with running values, name → Running: ``ahead`` along ``order_by`` in each BY group, ``behind`` from its end.

    Null levels are a group; without ``by`` the table is one, and counted as one. Ties in the order are broken one way for all
    values of a call. ``by_ranges``: None takes the scan by ranges where a group has over ``GROUP_ROWS``
    rows and plain windows elsewhere; both give the same rows. An empty table gives an empty table. Names
    of new columns replace columns of that name.
    """
    by, keys, ahead, behind = as_list(by), need_order(order_by), ahead or {}, behind or {}
    if by_ranges is None:
        by_ranges = has_hot_group(df, by)
    values = {f"__v_{k}": F.col(r.value) if isinstance(r.value, str) else r.value for k, r in (ahead | behind).items()}
    left = [c for c in df.columns if c not in ahead and c not in behind]
    df = df.withColumns(values)
    if not by_ranges:
        return _windows(df, by, keys, ahead, behind).select(*left, *ahead, *behind)
    return _ranges(df, by, keys, ahead, behind).select(*left, *ahead, *behind)


def _windows(df: DataFrame, by: list[str], keys: list[Column], ahead: dict[str, Running], behind: dict[str, Running]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*keys)
    new = {k: r.over(w, F.col(f"__v_{k}")) for k, r in ahead.items()}
    if behind:  # numbered by the same sort, so that both ways agree on ties
        new["__at"] = F.row_number().over(w)
    back = Window.partitionBy(*by).orderBy(F.desc("__at"))
    return df.withColumns(new).withColumns({k: r.over(back, F.col(f"__v_{k}")) for k, r in behind.items()})


def ranges(df: DataFrame, by: list[str], keys: list[Column], label: str = "ranges") -> DataFrame:
    """``df`` written once in ranges of (BY, keys), with __part, the range, and __at, which grows by one from row to row within it.

    Equal keys may lie in several ranges: a number of the row is the last key.
    """
    tied = df.withColumn("__tie", F.monotonically_increasing_id())
    order = [*[F.col(b).asc_nulls_first() for b in by], *keys, F.col("__tie").asc()]
    put = tied.repartitionByRange(*order).sortWithinPartitions(*order).drop("__tie").withColumn("__at", F.monotonically_increasing_id())
    return staged(put.withColumn("__part", F.shiftright("__at", 33)), label)


def _ranges(df: DataFrame, by: list[str], keys: list[Column], ahead: dict[str, Running], behind: dict[str, Running]) -> DataFrame:
    if not by:
        df, by = df.withColumn("__all", F.lit(0)), ["__all"]
    dealt = ranges(df, by, keys)
    level = F.struct(*[F.col(b).alias(f"b{i}") for i, b in enumerate(by)])
    edges = dealt.groupBy("__part").agg(
        F.min_by(level, "__at").alias("__head"), F.max_by(level, "__at").alias("__tail"), F.min("__at").alias("__from"), F.max("__at").alias("__to")
    )  # one row a range, as have all tables of states
    edges = staged(edges, "edges")
    out = dealt.join(F.broadcast(edges.drop("__from", "__to")), "__part")
    for runs, sign, gives, takes, end in ((ahead, 1, "__tail", "__head", "__to"), (behind, -1, "__head", "__tail", "__from")):
        if not runs:
            continue
        at, edge = F.lit(sign) * F.col("__at"), F.lit(sign) * F.col(end)
        given = dealt.join(F.broadcast(edges.select("__part", gives, end)), "__part").where(level.eqNullSafe(F.col(gives)))
        states = given.groupBy("__part").agg(F.first(gives).alias("__level"), *[r.state(F.col(f"__v_{k}"), at, edge).alias(f"__s_{k}") for k, r in runs.items()])
        taking = edges.select("__part", F.col(takes).alias("__level"), F.lit(0).alias("__giver"))
        both = states.withColumn("__giver", F.lit(1)).unionByName(taking, allowMissingColumns=True)
        w = Window.partitionBy("__level").orderBy((F.lit(sign) * F.col("__part")).asc(), "__giver")
        carried = both.withColumns({f"__c_{k}": r.folded(F.col(f"__s_{k}"), w) for k, r in runs.items()}).where("__giver = 0").select("__part", *[f"__c_{k}" for k in runs])
        inside = Window.partitionBy("__part", *by).orderBy(F.col("__at").asc() if sign == 1 else F.col("__at").desc())
        row, flows = F.row_number().over(inside), level.eqNullSafe(F.col(takes))
        out = out.withColumns({f"__o_{k}": r.over(inside, F.col(f"__v_{k}")) for k, r in runs.items()} | {"__row": row})
        out = out.join(F.broadcast(carried), "__part")
        out = out.withColumns({k: F.when(flows, r.joined(F.col(f"__c_{k}"), F.col(f"__o_{k}"), F.col("__row"))).otherwise(F.col(f"__o_{k}")) for k, r in runs.items()}).drop("__row")
    return out
