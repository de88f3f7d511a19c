"""Queries: scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import numeric as N
from ..functions import strings as S
from .registry import Registry

R = Registry()
q = R.query

_AREA = "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END"


@q("f1_case", "SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low FROM part")
def _(t):
    return t.part.select("p_partkey", S.upcase("p_name").alias("up"), S.lowcase("p_brand").alias("low"))


@q(
    "f2_propcase",
    "SELECT p_partkey, array_to_string([CASE WHEN i = 1 OR substr(s, i - 1, 1) IN (' ', '-', '/', '(') THEN upper(substr(s, i, 1)) ELSE lower(substr(s, i, 1)) END for i in range(1, length(s) + 1)], '') AS name FROM (SELECT p_partkey, p_type || '-' || p_name AS s FROM part)"
)
def _(t):
    return t.part.select("p_partkey", S.propcase(F.concat_ws("-", "p_type", "p_name")).alias("name"))


@q("f3_trim", "SELECT p_partkey, rtrim('  ' || p_name || '  ') AS t, trim('  ' || p_name || '  ') AS s, ltrim('  ' || p_name || '  ') AS l FROM part")
def _(t):
    x = F.concat(F.lit("  "), "p_name", F.lit("  "))
    return t.part.select("p_partkey", S.trim(x).alias("t"), S.strip(x).alias("s"), S.left(x).alias("l"))


@q(
    "f4_concatenate",
    f"SELECT p_partkey, p_brand || ' x ' || coalesce(CAST({_AREA} AS VARCHAR), '') AS cat, p_brand || 'x' || coalesce(CAST({_AREA} AS VARCHAR), '') AS cats, p_brand || ' x' || coalesce(CAST({_AREA} AS VARCHAR), '') AS catt, concat_ws('-', p_brand, 'x', CAST({_AREA} AS VARCHAR)) AS catx FROM part"
)
def _(t):
    size = F.when(F.col("p_partkey") % 7 != 0, F.col("p_size"))
    parts = ["p_brand", F.lit(" x "), size]
    return t.part.select("p_partkey", S.cat(*parts).alias("cat"), S.cats(*parts).alias("cats"), S.catt(*parts).alias("catt"), S.catx("-", *parts, F.lit(" ")).alias("catx"))


@q("f5_substr_index", "SELECT p_partkey, substr(p_name, 2, 3) AS mid, substr(p_name, 3) AS rest, CAST(strpos(p_type, 'A') AS INTEGER) AS at FROM part")
def _(t):
    return t.part.select("p_partkey", S.substr("p_name", 2, 3).alias("mid"), S.substr("p_name", 3).alias("rest"), S.index("p_type", "A").alias("at"))


@q(
    "f7_scan",
    "SELECT doc_id, [x for x in regexp_split_to_array(text, '[ ,.]+') if x <> ''][2] AS second, [x for x in regexp_split_to_array(text, '[ ,.]+') if x <> ''][-1] AS last FROM documents"
)
def _(t):
    return t.documents.select("doc_id", S.scan("text", 2, " ,.").alias("second"), S.scan("text", -1, " ,.").alias("last"))


@q("f8_tranwrd_compress", "SELECT doc_id, md5(replace(text, 'the', 'THE')) AS a, md5(replace(replace(text, ' ', ''), 'e', '')) AS b FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(S.tranwrd("text", "the", "THE")).alias("a"), F.md5(S.compress("text", " e")).alias("b"))


@q(
    "f10_patterns",
    "SELECT doc_id, md5(regexp_replace(text, '[0-9]+', '#', 'g')) AS changed, CAST(CASE WHEN regexp_matches(text, '[0-9]') THEN length(regexp_extract(text, '(?s)^([^0-9]*)[0-9]', 1)) + 1 ELSE 0 END AS INTEGER) AS digit FROM documents"
)
def _(t):
    return t.documents.select("doc_id", F.md5(S.prxchange("[0-9]+", "#", "text")).alias("changed"), S.anydigit("text").alias("digit"))


@q("f12_length", "SELECT p_partkey, CAST(greatest(length(rtrim(p_name || '   ')), 1) AS INTEGER) AS n FROM part")
def _(t):
    return t.part.select("p_partkey", S.length(F.concat("p_name", F.lit("   "))).alias("n"))


@q(
    "f13_put",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, upper(strftime(o_orderdate, '%d%b%Y')) AS d9, strftime(o_orderdate, '%m/%d/%Y') AS us, CAST(o_custkey AS VARCHAR) AS plain FROM orders"
)
def _(t):
    return t.orders.select(
        "o_orderkey", S.put("o_orderdate", "yymmdd10.").alias("iso"), S.put("o_orderdate", "date9.").alias("d9"), S.put("o_orderdate", "mmddyy10.").alias("us"),
        S.put("o_custkey", "best.").alias("plain")
    )


@q(
    "f14_input",
    "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS iso, CAST(o_orderdate AS DATE) AS d9, CAST(o_orderdate AS DATE) AS us, CAST(o_custkey AS DOUBLE) AS num, CAST(NULL AS DATE) AS bad FROM orders"
)
def _(t):
    d = F.col("o_orderdate")
    text = t.orders.select("o_orderkey", "o_custkey", F.date_format(d, "yyyy-MM-dd").alias("a"), D.date9(d).alias("b"), F.date_format(d, "MM/dd/yyyy").alias("c"))
    return text.select(
        "o_orderkey", S.input_("a", "is8601da.").alias("iso"), S.input_("b", "date9.").alias("d9"), S.input_("c", "anydtdte10.").alias("us"),
        S.input_(F.col("o_custkey").cast("string"), "best.").alias("num"), S.input_("c", "yymmdd10.").alias("bad")
    )


@q(
    "f15_math",
    "SELECT c_custkey, round(abs(c_acctbal), 6) AS a, CAST(ceil(c_acctbal) AS BIGINT) AS c, CAST(floor(c_acctbal) AS BIGINT) AS f, round(sqrt(abs(c_acctbal)), 6) AS s, round(exp(c_acctbal / 10000), 6) AS e, round(ln(abs(c_acctbal) + 1), 6) AS l, round(log2(abs(c_acctbal) + 1), 6) AS l2, round(log10(abs(c_acctbal) + 1), 6) AS l10, CAST(sign(c_acctbal) AS DOUBLE) AS sg FROM customer"
)
def _(t):
    b = F.col("c_acctbal")
    up = N.abs_(b) + 1
    r = lambda x: F.round(x, 6)
    return t.customer.select(
        "c_custkey", r(N.abs_(b)).alias("a"), N.ceil(b).alias("c"), N.floor(b).alias("f"), r(N.sqrt(N.abs_(b))).alias("s"), r(N.exp(b / 10000)).alias("e"),
        r(N.log(up)).alias("l"), r(N.log2(up)).alias("l2"), r(N.log10(up)).alias("l10"), N.sign(b).alias("sg")
    )


@q("f17_round", "SELECT c_custkey, round(c_acctbal, 1) AS r1, round(round(c_acctbal / 25) * 25, 4) AS r25, CAST(trunc(c_acctbal) AS BIGINT) AS i FROM customer")
def _(t):
    b = F.col("c_acctbal")
    return t.customer.select("c_custkey", N.round_(b, 1).alias("r1"), F.round(N.round_unit(b, 25.0), 4).alias("r25"), N.int_(b).alias("i"))


@q("f19_mod_power", "SELECT c_custkey, (c_custkey - 50) % 7 AS m, (((c_custkey - 50) % 7) + 7) % 7 AS mf, CAST(pow(c_nationkey, 2) AS DOUBLE) AS p FROM customer")
def _(t):
    x = F.col("c_custkey") - 50
    return t.customer.select("c_custkey", N.mod(x, 7).alias("m"), N.mod_floor(x, 7).alias("mf"), N.power("c_nationkey", 2).alias("p"))


_X = "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END"
_Y = "CASE WHEN l_linenumber IN (2, 3) THEN NULL ELSE l_tax END"


def _xy(t):
    n = F.col("l_linenumber")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", F.when(n != 3, F.col("l_quantity")).alias("x"), F.when(~n.isin(2, 3), F.col("l_tax")).alias("y"),
        F.when(n != 3, F.col("l_discount")).alias("z")
    )


@q(
    "f21_row_statistics",
    f"WITH d AS (SELECT l_orderkey, l_linenumber, {_X} AS x, {_Y} AS y FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN x IS NULL AND y IS NULL THEN NULL ELSE round(coalesce(x, 0) + coalesce(y, 0), 6) END AS s, round(CASE WHEN x IS NULL AND y IS NULL THEN NULL ELSE (coalesce(x, 0) + coalesce(y, 0)) / ((x IS NOT NULL)::INT + (y IS NOT NULL)::INT) END, 6) AS m, (x IS NOT NULL)::INT + (y IS NOT NULL)::INT AS n, (x IS NULL)::INT + (y IS NULL)::INT AS nm, least(x, y) AS mn, greatest(x, y) AS mx FROM d"
)
def _(t):
    return _xy(t).select(
        "l_orderkey", "l_linenumber", F.round(N.sum_of("x", "y"), 6).alias("s"), F.round(N.mean_of("x", "y"), 6).alias("m"), N.n_of("x", "y").alias("n"),
        N.nmiss_of("x", "y").alias("nm"), N.min_of("x", "y").alias("mn"), N.max_of("x", "y").alias("mx")
    )


@q(
    "f23_row_spread",
    f"WITH d AS (SELECT l_orderkey, l_linenumber, [e for e in [{_X}, {_Y}, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount END] if e IS NOT NULL] AS v FROM lineitem) SELECT l_orderkey, l_linenumber, round(list_max(v) - list_min(v), 6) AS rng, round(CASE WHEN len(v) > 1 THEN list_var_samp(v) END, 6) AS var, round(CASE WHEN len(v) > 1 THEN list_stddev_samp(v) END, 6) AS std, round(list_median(v), 6) AS med FROM d"
)
def _(t):
    v = ("x", "y", "z")
    return _xy(t).select(
        "l_orderkey", "l_linenumber", F.round(N.range_of(*v), 6).alias("rng"), F.round(N.var_of(*v), 6).alias("var"), F.round(N.std_of(*v), 6).alias("std"),
        F.round(N.median_of(*v), 6).alias("med")
    )


@q(
    "f24_coalesce_divide",
    f"WITH d AS (SELECT l_orderkey, l_linenumber, {_X} AS x, {_Y} AS y FROM lineitem) SELECT l_orderkey, l_linenumber, coalesce(y, x, -1) AS c, round(CASE WHEN y = 0 THEN NULL ELSE x / y END, 6) AS r FROM d"
)
def _(t):
    return _xy(t).select("l_orderkey", "l_linenumber", N.coalesce("y", "x", F.lit(-1)).alias("c"), F.round(N.divide("x", "y"), 6).alias("r"))


@q("f26_today", "SELECT current_date >= CAST(max(o_orderdate) AS DATE) AS past FROM orders")
def _(t):
    return t.orders.agg(F.max("o_orderdate").alias("last")).select((D.today() >= F.to_date("last")).alias("past"))


@q(
    "f27_date_parts",
    "SELECT event_id, year(ts) AS y, month(ts) AS m, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, CAST(second(ts) AS INTEGER) AS s, CAST(ts AS DATE) AS dp, strftime(ts, '%H:%M:%S') AS tp FROM events"
)
def _(t):
    c = F.col("ts")
    return t.events.select(
        "event_id", D.year(c).alias("y"), D.month(c).alias("m"), D.day(c).alias("d"), D.hour(c).alias("h"), D.minute(c).alias("mi"), D.second(c).alias("s"),
        D.datepart(c).alias("dp"), D.timepart(c).alias("tp")
    )


@q(
    "f30_make_dates",
    "SELECT o_orderkey, make_date(year(o_orderdate), month(o_orderdate), 1) AS first, CAST(o_orderdate AS DATE) AS again, CAST(CAST(o_orderdate AS DATE) - DATE '1992-01-01' AS INTEGER) AS days FROM orders"
)
def _(t):
    d = F.col("o_orderdate")
    return t.orders.select(
        "o_orderkey", D.mdy(F.month(d), F.lit(1), F.year(d)).alias("first"), D.ymd(F.date_format(d, "yyyy-MM-dd")).alias("again"),
        D.datdif(F.lit("1992-01-01").cast("date"), F.to_date(d)).alias("days")
    )


_D0, _D1 = "DATE '1995-06-17'", "CAST(o_orderdate AS DATE)"


@q(
    "f32_intck_discrete",
    f"SELECT o_orderkey, CAST(date_diff('day', {_D0}, {_D1}) AS BIGINT) AS d, CAST(floor(date_diff('day', {_D0} - CAST(dayofweek({_D0}) AS INTEGER), {_D1} - CAST(dayofweek({_D1}) AS INTEGER)) / 7) AS BIGINT) AS w, CAST(date_diff('month', {_D0}, {_D1}) AS BIGINT) AS m, CAST(date_diff('year', {_D0}, {_D1}) AS BIGINT) AS y FROM orders"
)
def _(t):
    a, b = F.lit("1995-06-17").cast("date"), F.to_date("o_orderdate")
    return t.orders.select("o_orderkey", *[D.intck(u, a, b).cast("bigint").alias(u[0]) for u in ("day", "week", "month", "year")])


@q("f32_intck_continuous", f"SELECT o_orderkey, CAST(date_sub('month', {_D0}, {_D1}) AS BIGINT) AS m, CAST(date_sub('year', {_D0}, {_D1}) AS BIGINT) AS y FROM orders")
def _(t):
    a, b = F.lit("1995-06-17").cast("date"), F.to_date("o_orderdate")
    return t.orders.select("o_orderkey", *[D.intck(u, a, b, "continuous").cast("bigint").alias(u[0]) for u in ("month", "year")])


@q(
    "f33_intnx",
    f"SELECT o_orderkey, CAST({_D1} + INTERVAL 1 MONTH AS DATE) AS same, CAST(date_trunc('month', {_D1} + INTERVAL 1 MONTH) AS DATE) AS beginning, last_day(CAST({_D1} + INTERVAL 1 MONTH AS DATE)) AS \"end\", {_D1} + 10 AS day10, CAST(date_trunc('year', {_D1} - INTERVAL 2 YEAR) AS DATE) AS year0 FROM orders"
)
def _(t):
    d = "o_orderdate"
    return t.orders.select(
        "o_orderkey", *[D.intnx("month", d, 1, a).alias(a) for a in ("same", "beginning", "end")], D.intnx("day", d, 10).alias("day10"),
        D.intnx("year", d, -2, "beginning").alias("year0")
    )


@q(
    "f35_sas_dates",
    f"SELECT o_orderkey, CAST({_D1} - DATE '1960-01-01' AS INTEGER) AS n, {_D1} AS back, CAST({_D1} - {_D0} AS INTEGER) AS diff, upper(strftime({_D1}, '%d%b%Y')) AS text FROM orders"
)
def _(t):
    n = D.to_sas_date(F.to_date("o_orderdate"))
    return t.orders.select(
        "o_orderkey", n.alias("n"), D.from_sas_date(n).alias("back"), D.days_between(F.to_date("o_orderdate"), F.lit("1995-06-17").cast("date")).alias("diff"),
        D.date9("o_orderdate").alias("text")
    )


@q("f36_yrdif", f"SELECT o_orderkey, CAST(date_sub('year', DATE '1970-03-05', {_D1}) AS INTEGER) AS age FROM orders")
def _(t):
    return t.orders.select("o_orderkey", D.yrdif(F.lit("1970-03-05").cast("date"), F.to_date("o_orderdate")).alias("age"))
