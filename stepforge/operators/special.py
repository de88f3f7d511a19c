"""Sums of logarithms, reciprocals and squared reciprocals of x, x + 1, …, x + n - 1 as columns, without a loop over n.

They are differences of the log-gamma, digamma and trigamma functions at x + n and x. Both arguments are
raised by ``_LIFT`` and the differences of the asymptotic series are written out, so that nothing cancels:
relative error is near that of doubles for x of 1 and more, whatever n.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LIFT = 10
#: Coefficients of the asymptotic series in odd (log-gamma, trigamma) and even (digamma) powers of 1 / x.
_LOG = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
_DI = (1 / 12, -1 / 120, 1 / 252, -1 / 240, 1 / 132)
_TRI = (1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66)


def _series(x: Column, coefficients, first: int) -> Column:
    """Sum of c / x**(first + 2 i), by Horner's rule."""
    square, out = 1 / (x * x), F.lit(0.0)
    for c in reversed(coefficients):
        out = F.lit(c) + square * out
    return out / (x if first == 1 else x * x if first == 2 else x * x * x)


def sum_log(x: Column, n: Column) -> Column:
    y = x + _LIFT
    z = y + n
    out = (y - 0.5) * F.log1p(n / y) + n * F.log(z) - n + _series(z, _LOG, 1) - _series(y, _LOG, 1)
    for i in range(_LIFT):
        out = out - F.log1p(n / (x + i))
    return out


def sum_inverse(x: Column, n: Column) -> Column:
    y = x + _LIFT
    z = y + n
    out = F.log1p(n / y) + 0.5 * n / (y * z) + _series(y, _DI, 2) - _series(z, _DI, 2)
    for i in range(_LIFT):
        out = out + n / ((x + i) * (x + i + n))
    return out


def sum_inverse_square(x: Column, n: Column) -> Column:
    y = x + _LIFT
    z = y + n
    out = n / (y * z) * (1 + 0.5 / y + 0.5 / z) + _series(y, _TRI, 3) - _series(z, _TRI, 3)
    for i in range(_LIFT):
        a, b = x + i, x + i + n
        out = out + n * (a + b) / (a * a * b * b)
    return out
