"""Queries: scalar functions one by one, over values that reach their edges (absent letters, blanks, zeros, signs, nulls, month ends)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import numeric as N
from ..functions import strings as S
from .registry import Registry

R = Registry()
q = R.query


@q(
    "f6_index",
    "SELECT doc_id, CAST(strpos(text, 'the') AS INTEGER) AS word, CAST(strpos(text, 'Q9z') AS INTEGER) AS absent, CAST(strpos(text, chr(10)) AS INTEGER) AS line, CAST(strpos(text, 'é') AS INTEGER) AS accent FROM documents"
)
def _(t):
    return t.documents.select("doc_id", *[S.index("text", x).alias(n) for n, x in (("word", "the"), ("absent", "Q9z"), ("line", "\n"), ("accent", "é"))])


@q("f9_compress", "SELECT doc_id, length(replace(text, ' ', '')) AS blanks, md5(translate(text, 'aeiou', '')) AS vowels, md5(translate(text, chr(10) || '.,é', '')) AS marks FROM documents")
def _(t):
    return t.documents.select(
        "doc_id", F.length(S.compress("text")).cast("bigint").alias("blanks"), F.md5(S.compress("text", "aeiou")).alias("vowels"),
        F.md5(S.compress("text", "\n.,é")).alias("marks")
    )


@q(
    "f11_anydigit_anyalpha",
    "SELECT doc_id, CAST(CASE WHEN regexp_matches(text, '[0-9]') THEN length(regexp_extract(text, '(?s)^([^0-9]*)[0-9]', 1)) + 1 ELSE 0 END AS INTEGER) AS digit, CAST(CASE WHEN regexp_matches(reverse(text), '[A-Za-z]') THEN length(regexp_extract(reverse(text), '(?s)^([^A-Za-z]*)[A-Za-z]', 1)) + 1 ELSE 0 END AS INTEGER) AS alpha FROM documents"
)
def _(t):
    return t.documents.select("doc_id", S.anydigit("text").alias("digit"), S.anyalpha(F.reverse("text")).alias("alpha"))


@q(
    "f16_logs_sign",
    "WITH d AS (SELECT c_custkey, CAST(c_custkey % 9 - 3 AS DOUBLE) * c_acctbal AS x FROM customer) SELECT c_custkey, CASE WHEN x > 0 THEN round(log2(x), 6) END AS l2, CASE WHEN x > 0 THEN round(log10(x), 6) END AS l10, CAST(sign(x) AS DOUBLE) AS s FROM d"
)
def _(t):
    x = (F.col("c_custkey") % 9 - 3).cast("double") * F.col("c_acctbal")
    return t.customer.select("c_custkey", x.alias("x")).select("c_custkey", F.round(N.log2("x"), 6).alias("l2"), F.round(N.log10("x"), 6).alias("l10"), N.sign("x").alias("s"))


@q(
    "f18_int",
    "SELECT c_custkey, CAST(trunc(c_acctbal / 7) AS BIGINT) AS i, CAST(trunc(-c_acctbal / 7) AS BIGINT) AS j, CAST(trunc((c_custkey % 3 - 1) * 0.9) AS BIGINT) AS zero FROM customer"
)
def _(t):
    x = F.col("c_acctbal") / 7
    return t.customer.select("c_custkey", N.int_(x).alias("i"), N.int_(-x).alias("j"), N.int_((F.col("c_custkey") % 3 - 1) * 0.9).alias("zero"))


@q(
    "f20_power",
    "SELECT c_custkey, CAST(pow(c_nationkey - 12, 3) AS DOUBLE) AS cube, round(pow(abs(c_acctbal), 0.5), 6) AS root, CAST(pow(c_nationkey, 0) AS DOUBLE) AS one, round(pow(c_nationkey + 1, -2), 9) AS less FROM customer"
)
def _(t):
    n = F.col("c_nationkey")
    return t.customer.select(
        "c_custkey", N.power(n - 12, 3).alias("cube"), F.round(N.power(F.abs("c_acctbal"), 0.5), 6).alias("root"), N.power(n, 0).alias("one"),
        F.round(N.power(n + 1, -2), 9).alias("less")
    )


_HOLES = "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 3 THEN l_quantity END AS x, CASE WHEN l_linenumber NOT IN (2, 3) THEN l_tax END AS y, CASE WHEN l_linenumber <> 3 THEN l_discount END AS z FROM lineitem"


def _holes(t):
    n = F.col("l_linenumber")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", F.when(n != 3, F.col("l_quantity")).alias("x"), F.when(~n.isin(2, 3), F.col("l_tax")).alias("y"),
        F.when(n != 3, F.col("l_discount")).alias("z")
    )


@q("f22_row_min_max", f"SELECT l_orderkey, l_linenumber, least(x, y, z) AS low, greatest(x, y, z) AS high FROM ({_HOLES})")
def _(t):
    return _holes(t).select("l_orderkey", "l_linenumber", N.min_of("x", "y", "z").alias("low"), N.max_of("x", "y", "z").alias("high"))


@q(
    "f25_missing_arithmetic",
    f"SELECT l_orderkey, l_linenumber, round(x + y, 6) AS added, round(x - z, 6) AS less, round(x * y, 6) AS times, CASE WHEN z <> 0 THEN round(x / z, 6) END AS ratio FROM ({_HOLES})"
)
def _(t):
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    return _holes(t).select(
        "l_orderkey", "l_linenumber", F.round(x + y, 6).alias("added"), F.round(x - z, 6).alias("less"), F.round(x * y, 6).alias("times"),
        F.round(N.divide(x, z), 6).alias("ratio")
    )


@q("f28_clock_parts", "SELECT event_id, hour(ts) AS h, minute(ts) AS m, CAST(second(ts) AS INTEGER) AS s FROM events")
def _(t):
    return t.events.select("event_id", D.hour("ts").alias("h"), D.minute("ts").alias("m"), D.second("ts").alias("s"))


@q("f29_date_and_time_part", "SELECT CAST(ts AS DATE) AS day, count(*) AS n, min(strftime(ts, '%H:%M:%S')) AS first, max(strftime(ts, '%H:%M:%S')) AS last FROM events GROUP BY 1")
def _(t):
    parts = t.events.select(D.datepart("ts").alias("day"), D.timepart("ts").alias("clock"))
    return parts.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.min("clock").alias("first"), F.max("clock").alias("last"))


_LAG = "make_date(CAST(year(o_orderdate) AS BIGINT), CAST(month(o_orderdate) AS BIGINT), 1)"


@q(
    "f31_datdif",
    f"SELECT o_orderkey, CAST(date_diff('day', {_LAG}, CAST(o_orderdate AS DATE)) AS INTEGER) AS since, CAST(date_diff('day', CAST(o_orderdate AS DATE), {_LAG}) AS INTEGER) AS until FROM orders"
)
def _(t):
    d = F.to_date("o_orderdate")
    first = D.mdy(F.month(d), F.lit(1), F.year(d))
    return t.orders.select("o_orderkey", D.datdif(first, d).alias("since"), D.datdif(d, first).alias("until"))


@q(
    "f34_days_between",
    "WITH o AS (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders GROUP BY 1) SELECT o_custkey, CAST(b - a AS INTEGER) AS days, CAST(last_day(b) - b AS INTEGER) AS rest FROM o"
)
def _(t):
    o = t.orders.groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b"))
    return o.select("o_custkey", D.days_between("b", "a").alias("days"), D.days_between(F.last_day("b"), F.col("b")).alias("rest"))


@q(
    "f37_date_formats",
    "SELECT o_orderkey, upper(strftime(o_orderdate, '%d%b%Y')) AS d9, strftime(o_orderdate, '%Y-%m-%d') AS iso, CAST(CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate END AS DATE) AS back FROM orders"
)
def _(t):
    d = F.col("o_orderdate")
    text = F.when(F.col("o_orderkey") % 4 != 0, D.date9(d)).otherwise("31FEB2024")
    return t.orders.select("o_orderkey", D.date9(d).alias("d9"), S.put(d, "is8601da.").alias("iso"), S.input_(text, "date9.").alias("back"))
