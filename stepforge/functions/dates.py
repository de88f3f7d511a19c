"""Date functions; numeric dates count days from 1960-01-01."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "1960-01-01"


def _d(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


today = F.current_date
year, month, day = F.year, F.month, F.dayofmonth
hour, minute, second = F.hour, F.minute, F.second


def datepart(x) -> Column:
    return F.to_date(_d(x))


def timepart(x) -> Column:
    return F.date_format(_d(x), "HH:mm:ss")


def mdy(m, d, y) -> Column:
    return F.make_date(_d(y), _d(m), _d(d))


def ymd(text) -> Column:
    return F.try_to_date(_d(text), "yyyy-MM-dd")


def datdif(start, end) -> Column:
    return F.datediff(_d(end), _d(start))


def days_between(a, b) -> Column:
    """a - b in days."""
    return F.datediff(_d(a), _d(b))


def intck(unit: str, start, end, method: str = "discrete") -> Column:
    """Interval boundaries crossed, or with "continuous" whole intervals elapsed; weeks begin on Sunday."""
    a, b = _d(start), _d(end)
    if method == "continuous":
        return F.timestamp_diff(unit.upper(), a.cast("timestamp"), b.cast("timestamp"))
    if unit == "day":
        return F.datediff(b, a)
    if unit == "week":
        sunday = lambda x: F.date_sub(x, F.dayofweek(x) - 1)
        return F.floor(F.datediff(sunday(b), sunday(a)) / 7)
    if unit == "hour":
        return F.floor((F.unix_timestamp(F.date_trunc("hour", b)) - F.unix_timestamp(F.date_trunc("hour", a))) / 3600)
    if unit == "year":
        return F.year(b) - F.year(a)
    return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)


def intnx(unit: str, start, n, alignment: str = "same") -> Column:
    """A date n intervals on: "same" day (clamped to the month's end), the interval's "beginning" or "end"."""
    d, n = F.to_date(_d(start)), F.lit(n) if isinstance(n, int) else _d(n)
    if unit == "day":
        return F.date_add(d, n)
    if unit == "week":
        moved = F.date_add(d, n * 7)
        first = F.date_sub(moved, F.dayofweek(moved) - 1)
        return {"same": moved, "beginning": first, "end": F.date_add(first, 6)}[alignment]
    moved = F.add_months(d, n * (12 if unit == "year" else 1))
    first = F.to_date(F.date_trunc(unit, moved))
    return {"same": moved, "beginning": first, "end": F.date_sub(F.add_months(first, 12 if unit == "year" else 1), 1)}[alignment]


def from_sas_date(n) -> Column:
    return F.date_add(F.lit(EPOCH).cast("date"), _d(n))


def to_sas_date(d) -> Column:
    return F.datediff(_d(d), F.lit(EPOCH).cast("date"))


def yrdif(start, end) -> Column:
    """Whole years of age."""
    return F.floor(F.months_between(_d(end), _d(start)) / 12).cast("int")


def date9(d) -> Column:
    return F.upper(F.date_format(_d(d), "ddMMMyyyy"))
