"""Numeric functions: row-wise statistics skip nulls, arithmetic with a null is null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _n(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


abs_, ceil, floor, sqrt, exp, log, log2, log10, sign = F.abs, F.ceil, F.floor, F.sqrt, F.exp, F.log, F.log2, F.log10, F.signum
coalesce = F.coalesce


def round_(x, digits: int = 0) -> Column:
    """To digits, halves away from zero."""
    return F.round(_n(x), digits)


def round_unit(x, unit: float) -> Column:
    """To the nearest multiple of ``unit``."""
    return F.round(_n(x) / F.lit(unit)) * F.lit(unit)


def int_(x) -> Column:
    """Toward zero."""
    return _n(x).cast("bigint")


def mod(x, y) -> Column:
    """With the sign of x."""
    return _n(x) % y


def mod_floor(x, y) -> Column:
    return F.pmod(_n(x), F.lit(y) if not isinstance(y, Column) else y)


def power(x, y) -> Column:
    return F.pow(_n(x), F.lit(y) if not isinstance(y, Column) else y)


def n_of(*xs) -> Column:
    return reduce(lambda a, b: a + b, [_n(x).isNotNull().cast("int") for x in xs])


def nmiss_of(*xs) -> Column:
    return reduce(lambda a, b: a + b, [_n(x).isNull().cast("int") for x in xs])


def sum_of(*xs) -> Column:
    total = reduce(lambda a, b: a + b, [F.coalesce(_n(x), F.lit(0)) for x in xs])
    return F.when(n_of(*xs) > 0, total)


def mean_of(*xs) -> Column:
    return F.try_divide(sum_of(*xs).cast("double"), n_of(*xs))


def min_of(*xs) -> Column:
    return F.least(*map(_n, xs))


def max_of(*xs) -> Column:
    return F.greatest(*map(_n, xs))


def _values(xs) -> Column:
    return F.filter(F.array(*[_n(x).cast("double") for x in xs]), lambda v: v.isNotNull())


def range_of(*xs) -> Column:
    return F.array_max(_values(xs)) - F.array_min(_values(xs))


def var_of(*xs) -> Column:
    v, n = _values(xs), n_of(*xs)
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n
    return F.when(n > 1, F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / (n - 1))


def std_of(*xs) -> Column:
    return F.sqrt(var_of(*xs))


def median_of(*xs) -> Column:
    v, n = F.sort_array(_values(xs)), n_of(*xs)
    return F.when(n > 0, (F.get(v, F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2)


def divide(a, b) -> Column:
    """Null on division by zero."""
    return F.try_divide(_n(a), _n(b))
