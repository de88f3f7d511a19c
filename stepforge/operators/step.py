"""The data step: ordered assignments, conditional chains, subsetting, arrays, metadata."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import existing


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


class Step:
    """Statements in written order over a frame; renames, keeps and drops wait for the end.

    ``Step(df).assign(a=…).subset(cond).keep("a").frame()``: every assignment sees the ones before.
    """

    def __init__(self, df: DataFrame):
        self.df, self._rename, self._keep, self._drop = df, {}, None, []

    def assign(self, **columns) -> Step:
        for name, value in columns.items():
            self.df = self.df.withColumn(name, _c(value))
        return self

    def subset(self, cond) -> Step:
        self.df = self.df.where(cond)
        return self

    def if_do(self, cond: Column, then: dict, else_: dict | None = None) -> Step:
        """Several variables on each branch; a variable of one branch only keeps its value on the other."""
        out = {}
        for name in {**then, **(else_ or {})}:
            old = F.col(name) if name in self.df.columns else F.lit(None)
            out[name] = F.when(cond, _c(then[name]) if name in then else old).otherwise(_c(else_[name]) if else_ and name in else_ else old)
        self.df = self.df.withColumns(out)
        return self

    def rename(self, names: dict[str, str]) -> Step:
        self._rename |= names
        return self

    def keep(self, *cols: str) -> Step:
        self._keep = [*(self._keep or []), *cols]
        return self

    def drop(self, *cols: str) -> Step:
        self._drop += cols
        return self

    def frame(self) -> DataFrame:
        df = self.df.withColumnsRenamed(self._rename)
        if self._keep is not None:
            df = df.select(*existing(df, self._keep))
        return df.drop(*self._drop)


def if_chain(branches: list[tuple[Column, object]], default=None, keep_existing: str | None = None) -> Column:
    """IF / ELSE IF / ELSE to one variable; without a default null, or the variable's own value."""
    out = None
    for cond, value in branches:
        out = F.when(cond, _c(value)) if out is None else out.when(cond, _c(value))
    if default is not None:
        return out.otherwise(_c(default))
    return out.otherwise(F.col(keep_existing)) if keep_existing else out


def select_when(expr: Column, values: dict, otherwise=None) -> Column:
    """SELECT / WHEN on equality."""
    out = if_chain([(expr == k, v) for k, v in values.items()])
    return out.otherwise(_c(otherwise))


def ifn(cond: Column, yes, no) -> Column:
    return F.when(cond, _c(yes)).otherwise(_c(no))


ifc = ifn


def array_cols(spec: str) -> list[str]:
    """Column names of a list such as ``x1-x5 y``; a range's numbers keep their width."""
    out = []
    for word in spec.split():
        m = re.fullmatch(r"([A-Za-z_]\w*?)(\d+)-\1(\d+)", word)
        out += [f"{m[1]}{i:0{len(m[2]) if m[2][0] == '0' else 0}d}" for i in range(int(m[2]), int(m[3]) + 1)] if m else [word]
    return out


def for_array(df: DataFrame, cols: list[str], fn: Callable[[Column, int], Column] | object, start: int = 1, stop: int | None = None, by: int = 1) -> DataFrame:
    """Set the elements start, start + by, … of a column list to a constant or to ``fn(element, index)``."""
    picked = list(range(start, (stop or len(cols)) + 1, by))
    if not callable(fn):
        return df.withColumns({cols[i - 1]: F.lit(fn) for i in picked})
    for i in picked:  # later elements may look at earlier ones
        df = df.withColumn(cols[i - 1], fn(F.col(cols[i - 1]), i))
    return df


def fold_while(init: Column, cond: Callable[[Column], Column], step: Callable[[Column], Column], max_iter: int) -> Column:
    """DO WHILE within a row: ``step`` is taken while ``cond`` holds, ``max_iter`` times at most."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(max_iter)), init, lambda acc, _: F.when(cond(acc), step(acc)).otherwise(acc))


def split_output(df: DataFrame, targets: dict[str, Column]) -> dict[str, DataFrame]:
    """OUTPUT to several tables; a row may go to several or none."""
    return {name: df.where(cond) for name, cond in targets.items()}


def set_meta(df: DataFrame, meta: dict[str, dict]) -> DataFrame:
    """Labels, formats and lengths as column metadata."""
    for name, m in meta.items():
        df = df.withMetadata(name, {**df.schema[name].metadata, **m})
    return df


def apply_format(df: DataFrame, col: str, labels: dict, name: str, ranges: list[tuple] = (), other: str | None = None) -> DataFrame:
    """Value labels by value, then by range (low, high, label), both ends included."""
    c = F.col(col)
    chain = [(c == k, v) for k, v in labels.items()] + [(c.between(lo, hi), v) for lo, hi, v in ranges]
    return df.withColumn(name, if_chain(chain).otherwise(F.lit(other) if other is not None else c.cast("string")))


def to_numeric(name: str) -> Column:
    return F.col(name).try_cast("double")


def with_nobs(df: DataFrame, name: str = "_nobs_") -> DataFrame:
    """The number of rows on every row: one aggregated row, broadcast."""
    return df.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias(name))))


def search(df: DataFrame, text: str, cols: list[str] | None = None) -> DataFrame:
    """Rows with ``text`` in any column, in either case."""
    found = F.lit(False)
    for c in cols or df.columns:
        found = found | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(text.lower())), F.lit(False))
    return df.where(found)


def page(df: DataFrame, order_by, size: int, number: int) -> DataFrame:
    """Page ``number`` (from 0) of a stated order."""
    from .rules import need_order

    return df.orderBy(*need_order(order_by)).offset(number * size).limit(size)


def define(fn: Callable[..., Column]) -> Callable[..., Column]:
    """A user function as a column macro: names and values become columns before the call."""
    return lambda *args: fn(*[F.col(a) if isinstance(a, str) else _c(a) for a in args])
