"""Queries: statistical models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models as M
from . import solve_sql as S
from .registry import Registry

R = Registry()
q = R.query

# Time in days from a customer's first to last order; an event where the last order is final.
_SURV = "SELECT o_custkey, CAST(date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE) AS DOUBLE) AS time, CAST(arg_max(o_orderstatus, o_orderkey) = 'F' AS INTEGER) AS event, any_value(c_mktsegment) AS seg FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1"


def _surv(t):
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).cast("double").alias("time"),
        (F.max_by("o_orderstatus", "o_orderkey") == "F").cast("int").alias("event")
    )
    return o.join(t.customer.select("c_custkey", "c_acctbal", F.col("c_mktsegment").alias("seg")), "c_custkey")


def _rounded(df, **digits):
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


def _terms(names, of) -> str:
    """One row a term: (its name, of(its position))."""
    return " UNION ALL ".join(f"SELECT '{n}' AS term, {of(i)}" for i, n in enumerate(names))


@q(
    "m1_reg",
    "SELECT CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(1 - (1 - regr_r2(l_extendedprice, l_quantity)) * (count(*) - 1) / (count(*) - 2), 6) AS adj_r2, round(sqrt((regr_syy(l_extendedprice, l_quantity) - pow(regr_sxy(l_extendedprice, l_quantity), 2) / regr_sxx(l_extendedprice, l_quantity)) / (count(*) - 2)), 3) AS root_mse FROM lineitem"
)
def _(t):
    return M.reg(t.lineitem, "l_extendedprice", "l_quantity").statistics().select(
        "n", F.round("r2", 6).alias("r2"), F.round("adj_r2", 6).alias("adj_r2"), F.round("root_mse", 3).alias("root_mse")
    )


@q(
    "m1_reg_coefficients",
    "SELECT 'intercept' AS term, round(regr_intercept(l_extendedprice, l_quantity), 3) AS estimate FROM lineitem UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 3) FROM lineitem"
)
def _(t):
    return M.reg(t.lineitem, "l_extendedprice", "l_quantity").coefficients().select("term", F.round("estimate", 3).alias("estimate"))


_FIT = "SELECT count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, regr_avgx(l_extendedprice, l_quantity) AS mx, regr_sxx(l_extendedprice, l_quantity) AS sxx, (regr_syy(l_extendedprice, l_quantity) - pow(regr_sxy(l_extendedprice, l_quantity), 2) / regr_sxx(l_extendedprice, l_quantity)) / (count(*) - 2) AS mse FROM lineitem"


@q(
    "m2_reg_inference",
    f"WITH f AS ({_FIT}) SELECT 'intercept' AS term, round(sqrt(mse * (1 / n + mx * mx / sxx)), 4) AS se, round(a / sqrt(mse * (1 / n + mx * mx / sxx)), 4) AS t FROM f UNION ALL SELECT 'l_quantity', round(sqrt(mse / sxx), 4), round(b / sqrt(mse / sxx), 4) FROM f"
)
def _(t):
    return M.reg(t.lineitem, "l_extendedprice", "l_quantity").coefficients().select("term", F.round("se", 4).alias("se"), F.round("t", 4).alias("t"))


_X4 = [("x0", "1"), ("x1", "l_quantity"), ("x2", "l_discount"), ("x3", "l_tax")]
_NORMAL = f"""d AS (SELECT {", ".join(f"CAST({v} AS DOUBLE) AS {n}" for n, v in _X4)}, CAST(l_extendedprice AS DOUBLE) - (SELECT avg(l_extendedprice) FROM lineitem) AS y, (SELECT avg(l_extendedprice) FROM lineitem) AS base FROM lineitem),
n AS MATERIALIZED (SELECT 0 AS k, count(*) AS n, sum(y * y) AS yy, any_value(base) AS base, {", ".join(f"sum(x{i} * x{j}) AS h{i}_{j}" for i in range(4) for j in range(i, 4))}, {", ".join(f"sum(x{i} * y) AS g{i}" for i in range(4))} FROM d),
{S.solved("e", "n", 4)},
f AS (SELECT *, (yy - s0 * g0 - s1 * g1 - s2 * g2 - s3 * g3) / (n - 4) AS mse FROM n JOIN e USING (k))"""


@q(
    "m2_reg_multiple",
    f"WITH {_NORMAL}, o AS ({
        _terms(['intercept', 'l_quantity', 'l_discount', 'l_tax'], lambda i: f's{i}' + (' + base' if not i else '') + f' AS b, sqrt(mse * v{i}_{i}) AS s, n - 4 AS v FROM f')
    }) SELECT term, round(b, 3) AS estimate, round(s, 4) AS se, round(b / s, 5) AS t, round({S.tail('b / s', 'v')}, 5) AS p_value FROM o"
)
def _(t):
    return _rounded(M.reg(t.lineitem, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]).coefficients(), estimate=3, se=4, t=5, p_value=5)


@q("m2_reg_absorb", """WITH d AS (SELECT l_quantity - avg(l_quantity) OVER w AS x, l_extendedprice - avg(l_extendedprice) OVER w AS y, l_suppkey FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)),
f AS (SELECT count(*) - count(DISTINCT l_suppkey) - 1 AS v, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy FROM d)
SELECT 'l_quantity' AS term, round(xy / xx, 4) AS estimate, round(sqrt((yy - xy * xy / xx) / v / xx), 5) AS se, round(xy / xx / sqrt((yy - xy * xy / xx) / v / xx), 5) AS t FROM f""")
def _(t):
    return _rounded(M.reg_absorb(t.lineitem, "l_extendedprice", "l_quantity", "l_suppkey").coefficients().drop("p_value"), estimate=4, se=5, t=5)


@q("m3_anova", """WITH g AS (SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY 1), a AS (SELECT count(*) - 1 AS d1, sum(n) - count(*) AS d2, sum(n * pow(m - (SELECT avg(o_totalprice) FROM orders), 2)) AS ssb, sum((n - 1) * v) AS ssw FROM g)
SELECT 'o_orderpriority' AS term, CAST(d1 AS BIGINT) AS df, round(ssb / ssw, 9) AS ratio, round((ssb / d1) / (ssw / d2), 5) AS f FROM a UNION ALL SELECT 'residuals', CAST(d2 AS BIGINT), 1.0, NULL FROM a""")
def _(t):
    a = M.anova(t.orders, "o_totalprice", ["o_orderpriority"])
    return a.crossJoin(a.where("term = 'residuals'").select(F.col("ss").alias("r"))).select("term", "df", F.round(F.col("ss") / F.col("r"), 9).alias("ratio"), F.round("f", 5).alias("f"))


# sequential sums of squares: y on the intercept, on returnflag, on both factors (by their normal equations), on all cells
_PAIR = f"""d AS (SELECT CAST(l_extendedprice AS DOUBLE) - (SELECT avg(l_extendedprice) FROM lineitem) AS y, l_returnflag AS a, l_linestatus AS b FROM lineitem),
x AS (SELECT y, 1.0 AS x0, CAST(a = 'N' AS DOUBLE) AS x1, CAST(a = 'R' AS DOUBLE) AS x2, CAST(b = 'O' AS DOUBLE) AS x3 FROM d),
n AS MATERIALIZED (SELECT 0 AS k, {", ".join(f"sum(x{i} * x{j}) AS h{i}_{j}" for i in range(4) for j in range(i, 4))}, {", ".join(f"sum(x{i} * y) AS g{i}" for i in range(4))} FROM x),
{S.solved("e", "n", 4)},
s AS (SELECT (SELECT sum(y * y) FROM d) AS s0, (SELECT sum((y - m) * (y - m)) FROM (SELECT y, avg(y) OVER (PARTITION BY a) AS m FROM d)) AS s1,
  (SELECT sum(y * y) FROM d) - (SELECT s0 * g0 + s1 * g1 + s2 * g2 + s3 * g3 FROM n JOIN e USING (k)) AS s2, (SELECT sum((y - m) * (y - m)) FROM (SELECT y, avg(y) OVER (PARTITION BY a, b) AS m FROM d)) AS s3,
  (SELECT count(*) FROM d) AS n, (SELECT count(DISTINCT (a, b)) FROM d) AS c)"""


@q("m3_anova_interaction", f"""WITH {_PAIR}, o AS (SELECT 'l_returnflag' AS term, 2 AS df, s0 - s1 AS ss FROM s UNION ALL SELECT 'l_linestatus', 1, s1 - s2 FROM s UNION ALL SELECT 'l_returnflag*l_linestatus', c - 4, s2 - s3 FROM s UNION ALL SELECT 'residuals', n - c, s3 FROM s)
SELECT term, CAST(df AS BIGINT) AS df, round(ss / s3, 9) AS ratio, CASE WHEN term <> 'residuals' THEN round(ss / df / (s3 / (n - c)), 5) END AS f FROM o, s WHERE df > 0""")
def _(t):
    a = M.anova(t.lineitem, "l_extendedprice", ["l_returnflag", "l_linestatus", "l_returnflag*l_linestatus"])
    return a.crossJoin(a.where("term = 'residuals'").select(F.col("ss").alias("r"))).select("term", "df", F.round(F.col("ss") / F.col("r"), 9).alias("ratio"), F.round("f", 5).alias("f"))


@q("m3_anova_many_levels", """WITH d AS (SELECT CAST(l_suppkey AS VARCHAR) AS k, CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem), m AS (SELECT count(*) AS n, count(DISTINCT k) AS c, var_pop(y) * count(*) AS s0 FROM d),
w AS (SELECT x - avg(x) OVER (PARTITION BY k) AS x, y - avg(y) OVER (PARTITION BY k) AS y FROM d), s AS (SELECT n, c, s0, sum(y * y) AS s1, sum(y * y) - pow(sum(x * y), 2) / sum(x * x) AS s2 FROM w, m GROUP BY n, c, s0)
SELECT 'supplier' AS term, CAST(c - 1 AS BIGINT) AS df, round((s0 - s1) / s2, 8) AS ratio, round((s0 - s1) / (c - 1) / (s2 / (n - c - 1)), 5) AS f FROM s UNION ALL SELECT 'l_quantity', 1, round((s1 - s2) / s2, 8), round((s1 - s2) / (s2 / (n - c - 1)), 5) FROM s UNION ALL SELECT 'residuals', CAST(n - c - 1 AS BIGINT), 1.0, NULL FROM s""")
def _(t):
    a = M.anova(t.lineitem.withColumn("supplier", F.col("l_suppkey").cast("string")), "l_extendedprice", ["supplier", "l_quantity"])
    return a.crossJoin(a.where("term = 'residuals'").select(F.col("ss").alias("r"))).select("term", "df", F.round(F.col("ss") / F.col("r"), 8).alias("ratio"), F.round("f", 5).alias("f"))


@q("m4_tukey", """WITH g AS (SELECT o_orderpriority AS k, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY 1), e AS (SELECT sum((n - 1) * v) / (sum(n) - count(*)) AS mse FROM g)
SELECT x.k AS a, y.k AS b, round(y.m - x.m, 4) AS diff, round(abs(y.m - x.m) / sqrt(mse / 2 * (1 / x.n + 1 / y.n)), 6) AS q FROM g x JOIN g y ON x.k < y.k, e""")
def _(t):
    return M.tukey(t.orders, "o_totalprice", "o_orderpriority").select("a", "b", F.round("diff", 4).alias("diff"), F.round("q", 6).alias("q"))


_PRIORITIES = ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]  # beside the first, 1-URGENT
_FINAL = f"""SELECT CAST(o_orderstatus = 'F' AS DOUBLE) AS y, CAST(o_totalprice AS DOUBLE) / 100000 AS x0, {", ".join(f"CAST(o_orderpriority = '{p}' AS DOUBLE) AS x{i + 1}" for i, p in enumerate(_PRIORITIES))},
1.0::DOUBLE AS x5 FROM orders WHERE o_totalprice IS NOT NULL AND o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL"""
_FINAL_TERMS = ["k", *[f"o_orderpriority_{p}" for p in _PRIORITIES], "intercept"]


@q("m5_logistic", f"""WITH d AS MATERIALIZED ({_FINAL}), {S.logistic('d', 6)}, o AS ({_terms(_FINAL_TERMS, lambda i: f'b{i} AS b, sqrt(v{i}_{i}) AS s FROM b JOIN e USING (k)')})
SELECT term, round(b, 6) AS estimate, round(s, 6) AS se, round(b / s, 5) AS z, round({S.tail('b / s')}, 6) AS p_value, round(exp(b), 5) AS odds_ratio FROM o""")
def _(t):
    df = t.orders.select((F.col("o_orderstatus") == "F").alias("y"), "o_orderpriority", (F.col("o_totalprice") / 100000).alias("k"))
    return _rounded(M.logistic(df, "y ~ k + o_orderpriority").drop("wald_low", "wald_high"), estimate=6, se=6, z=5, p_value=6, odds_ratio=5)


_M = "l_extendedprice", "l_quantity", "l_suppkey"
_MIXED = "d AS (SELECT l_suppkey AS grp, 1.0::DOUBLE AS x0, CAST(l_quantity AS DOUBLE) AS x1, CAST(l_extendedprice AS DOUBLE) AS x2 FROM lineitem)"


@q(
    "m7_mixed",
    f"WITH {_MIXED}, {S.mixed('d', 2)}, o AS ({
        _terms(['intercept', 'l_quantity'], lambda i: f's{i} AS b, sqrt(mse * v{i}_{i}) AS s FROM fit')
    }) SELECT term, round(b, 4) AS estimate, round(s, 4) AS se, round(b / s, 4) AS z, round({S.tail('b / s')}, 5) AS p_value FROM o"
)
def _(t):
    return _rounded(M.mixed(t.lineitem, *_M).coefficients(), estimate=4, se=4, z=4, p_value=5)


@q(
    "m7_mixed_variances",
    f"WITH d AS (SELECT o_custkey AS grp, 1.0::DOUBLE AS x0, ln(o_totalprice + 1) + o_custkey % 7 AS x1 FROM orders), {S.mixed('d', 1)} SELECT round(mse, 6) AS residual, round(lam * mse, 5) AS intercept, (SELECT count(*) FROM d) AS n, (SELECT count(DISTINCT grp) FROM d) AS subjects FROM fit"
)
def _(t):
    df = t.orders.select("o_custkey", (F.log(F.col("o_totalprice") + 1) + F.col("o_custkey") % 7).alias("y"))
    return _rounded(M.mixed(df, "y", [], "o_custkey").variances(), residual=6, intercept=5)


@q(
    "m8_lsmeans",
    f"WITH {_MIXED}, {S.mixed('d', 2)} SELECT label, round(s0 + level * s1, 4) AS estimate, round(sqrt(mse * (v0_0 + 2 * level * v0_1 + level * level * v1_1)), 4) AS se FROM fit, (VALUES ('ten', 10.0::DOUBLE), ('forty', 40.0::DOUBLE)) v(label, level)"
)
def _(t):
    return _rounded(M.lsmeans(M.mixed(t.lineitem, *_M), [{"l_quantity": 10.0}, {"l_quantity": 40.0}], ["ten", "forty"]), estimate=4, se=4)


@q(
    "m9_estimate",
    f"WITH {_MIXED.replace('AS x2', 'AS x3, CAST(l_tax AS DOUBLE) AS x2')}, {S.mixed('d', 3)}, o AS (SELECT 5 * s1 - 0.01 * s2 AS b, sqrt(mse * (25 * v1_1 - 0.1 * v1_2 + 0.0001 * v2_2)) AS s FROM fit) SELECT round(b, 4) AS estimate, round(s, 4) AS se, round(b / s, 4) AS z, round({S.tail('b / s')}, 5) AS p_value FROM o"
)
def _(t):
    return _rounded(M.mixed(t.lineitem, "l_extendedprice", ["l_quantity", "l_tax"], "l_suppkey").estimate(l_quantity=5.0, l_tax=-0.01), estimate=4, se=4, z=4, p_value=5)


_COX = _SURV.replace("any_value(c_mktsegment) AS seg", "{seg} AS seg, CAST(any_value(c_acctbal) AS DOUBLE) / 1000 AS x")


@q(
    "m10_cox",
    f"WITH s AS MATERIALIZED ({_COX.format(seg='any_value(c_mktsegment)')}), {S.cox('s')} SELECT 'x' AS term, round(b, 6) AS estimate, round(1 / sqrt(h), 6) AS se, round(b * sqrt(h), 4) AS z, round({S.tail('b * sqrt(h)')}, 5) AS p_value, round(exp(b), 6) AS hazard_ratio FROM e"
)
def _(t):
    fit = M.cox(_surv(t).withColumn("x", F.col("c_acctbal") / 1000), "time", "event", "x", "seg").coefficients()
    return _rounded(fit.drop("wald_low", "wald_high"), estimate=6, se=6, z=4, p_value=5, hazard_ratio=6)


@q(
    "m12_ph_test",
    f"WITH s AS MATERIALIZED ({_COX.format(seg=1)}), {S.cox('s')}, c AS (SELECT corr(time, x / d - r1 / r0) AS rho, count(*) AS n FROM r WHERE d > 0) SELECT 'x' AS term, round(rho, 5) AS rho, round(n * rho * rho, 4) AS chi2, round({S.tail('sqrt(n) * rho')}, 5) AS p_value FROM c"
)
def _(t):
    return _rounded(M.cox(_surv(t).withColumn("x", F.col("c_acctbal") / 1000), "time", "event", "x").ph_test(), rho=5, chi2=4, p_value=5)


@q("m13_km", f"""WITH s AS ({_SURV}), r AS (SELECT seg, time, CAST(sum(event) AS BIGINT) AS events, CAST(count(*) - sum(event) AS BIGINT) AS censored, CAST(sum(count(*)) OVER (PARTITION BY seg ORDER BY time DESC) AS BIGINT) AS at_risk FROM s GROUP BY 1, 2),
k AS (SELECT *, sum(CASE WHEN at_risk = events THEN NULL ELSE ln(1 - events / at_risk) END) OVER (PARTITION BY seg ORDER BY time) AS l, bool_or(at_risk = events) OVER (PARTITION BY seg ORDER BY time) AS z, sum(CASE WHEN at_risk > events THEN events / (at_risk * (at_risk - events)) END) OVER (PARTITION BY seg ORDER BY time) AS g FROM r)
SELECT seg, time, events, censored, at_risk, round(CASE WHEN z THEN 0 ELSE exp(coalesce(l, 0)) END, 6) AS survival, round(CASE WHEN z THEN 0 ELSE exp(coalesce(l, 0)) END * sqrt(g), 6) AS se FROM k""")
def _(t):
    out = M.km(_surv(t), "time", "event", "seg")
    return out.withColumns({"survival": F.round("survival", 6), "se": F.round("se", 6)})


_LOGRANK = f"""WITH s AS ({_SURV}), e AS (SELECT time, sum(event) AS d FROM s GROUP BY 1 HAVING sum(event) > 0), x AS (SELECT e.time, e.d, seg, count(*) AS k, sum(count(*)) OVER (PARTITION BY e.time) AS r FROM e JOIN s ON s.time >= e.time GROUP BY 1, 2, 3)
SELECT seg, (SELECT CAST(count(*) AS BIGINT) FROM s WHERE s.seg = x.seg) AS n, (SELECT CAST(sum(event) AS BIGINT) FROM s WHERE s.seg = x.seg) AS observed, round(sum(d * k / r), 5) AS expected FROM x GROUP BY 1"""


@q("m14_logrank_table", _LOGRANK)
def _(t):
    return M.logrank_table(_surv(t), "time", "event", "seg").withColumn("expected", F.round("expected", 5))


@q(
    "m14_logrank",
    f"SELECT round(sum(pow(observed - expected, 2) / expected), 4) AS chi2, CAST(count(*) - 1 AS BIGINT) AS df FROM ({_LOGRANK.replace('round(sum(d * k / r), 5)', 'sum(d * k / r)')})"
)
def _(t):
    return M.logrank(_surv(t), "time", "event", "seg").select(F.round("chi2", 4).alias("chi2"), "df")
