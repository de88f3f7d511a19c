"""String functions with the documented meaning: 1-based positions, blanks trimmed where they are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _s(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


upcase = F.upper
lowcase = F.lower
strip = F.trim


def trim(x) -> Column:
    """Without trailing blanks."""
    return F.rtrim(_s(x))


def left(x) -> Column:
    """Without leading blanks."""
    return F.ltrim(_s(x))


right = trim


def propcase(x) -> Column:
    """Capital first letters, also after '-', '/' and '('."""
    letters = F.split(F.lower(_s(x)), "")
    at = F.transform(letters, lambda c, i: F.when((i == 0) | F.get(letters, i - 1).isin(" ", "-", "/", "(", "\t"), F.upper(c)).otherwise(c))
    return F.array_join(at, "")


def cat(*xs) -> Column:
    return F.concat(*[F.coalesce(_s(x).cast("string"), F.lit("")) for x in xs])


def cats(*xs) -> Column:
    return F.concat(*[F.coalesce(F.trim(_s(x).cast("string")), F.lit("")) for x in xs])


def catt(*xs) -> Column:
    return F.concat(*[F.coalesce(F.rtrim(_s(x).cast("string")), F.lit("")) for x in xs])


def catx(sep: str, *xs) -> Column:
    """Joined by ``sep``; nulls and blanks are left out."""
    return F.concat_ws(sep, *[F.nullif(F.trim(_s(x).cast("string")), F.lit("")) for x in xs])


def substr(x, start: int, length: int | None = None) -> Column:
    return F.substring(_s(x), F.lit(start), F.lit(length) if length is not None else F.length(_s(x)))


def index(x, find: str) -> Column:
    """1-based position, 0 if absent."""
    return F.instr(_s(x), find)


def scan(x, n: int, delims: str = " ") -> Column:
    """The n-th word; from the end if negative; null if there is none."""
    pattern = "[" + "".join("\\" + c if not c.isalnum() and c != " " else c for c in delims) + "]+"
    words = F.filter(F.split(_s(x), pattern), lambda e: e != "")
    return F.get(words, F.lit(n - 1)) if n > 0 else F.get(words, F.size(words) + n)


def tranwrd(x, old: str, new: str) -> Column:
    return F.replace(_s(x), F.lit(old), F.lit(new))


def compress(x, chars: str = " ") -> Column:
    return F.translate(_s(x), chars, "")


def prxmatch(pattern: str, x) -> Column:
    """1-based position of the first match, 0 if none."""
    x = _s(x)
    before = F.element_at(F.split(x, pattern, 2), 1)
    return F.when(F.rlike(x, F.lit(pattern)), F.length(before) + 1).when(x.isNotNull(), 0)


def prxchange(pattern: str, new: str, x) -> Column:
    return F.regexp_replace(_s(x), pattern, new)


def anydigit(x) -> Column:
    return prxmatch("[0-9]", x)


def anyalpha(x) -> Column:
    return prxmatch("[A-Za-z]", x)


def length(x) -> Column:
    """Without trailing blanks, at least 1."""
    return F.greatest(F.length(F.rtrim(F.coalesce(_s(x), F.lit("")))), F.lit(1))


_DATE = {"yymmdd": "yyyy-MM-dd", "is8601": "yyyy-MM-dd", "date": "ddMMMyyyy", "mmddyy": "MM/dd/yyyy", "ddmmyy": "dd/MM/yyyy", "julian": "yyyyDDD"}


def _format(fmt: str) -> str | None:
    stem = fmt.lower().rstrip(".").rstrip("0123456789")
    return _DATE.get("is8601" if fmt.lower().startswith(("is8601", "e8601")) else stem)


def put(x, fmt: str) -> Column:
    """Text of a date under a date format (upper case), else the plain text of a value."""
    pattern = _format(fmt)
    return F.upper(F.date_format(_s(x), pattern)) if pattern else _s(x).cast("string")


def input_(x, fmt: str) -> Column:
    """A date under a date format, ISO, day-month or US order for anydtdte, else a number; null where it is none."""
    x = _s(x)
    if fmt.lower().startswith("anydtdte"):
        return F.coalesce(F.try_to_date(x, "yyyy-MM-dd"), F.try_to_date(F.initcap(F.lower(x)), "ddMMMyyyy"), F.try_to_date(x, "MM/dd/yyyy"))
    pattern = _format(fmt)
    if pattern is None:
        return x.try_cast("double")
    if "MMM" in pattern:
        x = F.concat(F.substring(x, 1, 2), F.initcap(F.lower(F.substring(x, 3, 100))))
    return F.try_to_date(x, pattern)
