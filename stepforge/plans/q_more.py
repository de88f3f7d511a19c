"""Queries: variants of the operators that the other groups use inside larger queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import clinical as D
from ..operators import combine as J
from ..operators import models as M
from ..operators import order as W
from ..operators import programs as K
from ..operators import quality as Q
from ..operators import step as P
from ..operators import summary as A
from ..operators.rules import numeric_cols
from ..operators.storage import shared_dir
from ..sources import readers as S
from . import solve_sql
from .q_models import _COX, _surv
from .q_programs import _E, _UP, _edges, uploads
from .registry import Registry

R = Registry()
q = R.query


def _folder(t, name: str) -> str:
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@q("s2_delimited", "SELECT c_custkey, c_name FROM customer")
def _(t):
    path = _folder(t, "delimited")
    t.customer.select("c_custkey", F.col("c_name").alias("C_NAME")).write.option("sep", "|").option("header", True).csv(path)
    return S.read_delim(t.spark, path, "|", "c_custkey bigint, c_name string")


@q("s5_tolerant_csv", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 5 <> 0")
def _(t):
    path = _folder(t, "tolerant")
    bad = F.when(F.col("o_orderkey") % 5 == 0, F.lit("not a number")).otherwise(F.col("o_orderkey").cast("string"))
    t.orders.select(bad.alias("o_orderkey"), "o_custkey").write.option("header", True).csv(path)
    return S.read_csv(t.spark, path, schema="o_orderkey bigint, o_custkey bigint", mode="DROPMALFORMED").select("o_orderkey", "o_custkey")


@q("s6_sample", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10000")
def _(t):
    return S.sample(t.orders, 10_000, order_by="o_orderkey")


@q("s6_spread_sample", "SELECT * FROM orders WHERE CAST('0x' || left(md5(CAST(o_orderkey AS VARCHAR)), 8) AS BIGINT) < 429496729")
def _(t):
    return S.sample(t.orders, fraction=0.1, key="o_orderkey")


@q("s7_inline_rows", "SELECT o_orderstatus, word FROM orders LEFT JOIN (VALUES ('F', 'final'), ('O', NULL)) v(st, word) ON st = o_orderstatus")
def _(t):
    words = S.inline(t.spark, [("F", "final"), ("O",)], "o_orderstatus string, word string")
    return t.orders.select("o_orderstatus").join(words, "o_orderstatus", "left")


@q("s12_csv_export", "SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def _(t):
    path = _folder(t, "export")
    S.write_csv(t.supplier.select("s_suppkey", "s_name", "s_nationkey"), path)
    return S.read_csv(t.spark, path, schema="s_suppkey bigint, s_name string, s_nationkey int")


@q("p3_drop", "SELECT n_nationkey, n_regionkey FROM nation")
def _(t):
    return P.Step(t.nation).drop("n_name", "absent").frame()


@q("p4_rename", "SELECT r_regionkey AS id, r_name AS name FROM region")
def _(t):
    return P.Step(t.region).rename({"r_regionkey": "id", "r_name": "name"}).frame()


@q("p5_keep_on_input", "SELECT l_orderkey AS o_orderkey, l_quantity, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(t):
    items = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity")
    return J.merge(items, t.orders.select("o_orderkey", "o_orderstatus"), "o_orderkey", keep_if="a and b")


@q("p13_logic", "SELECT CAST(count(*) FILTER (WHERE (l_quantity > 40 AND NOT l_returnflag = 'R') OR l_tax = 0) AS BIGINT) AS n FROM lineitem")
def _(t):
    return t.lineitem.agg(F.count_if(((F.col("l_quantity") > 40) & ~(F.col("l_returnflag") == "R")) | (F.col("l_tax") == 0)).alias("n"))


@q("p18_array_of_columns", "SELECT l_orderkey, l_linenumber, round(l_discount + l_tax, 6) AS total FROM lineitem")
def _(t):
    from ..functions.numeric import sum_of

    df = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_discount").alias("v1"), F.col("l_tax").alias("v2"))
    return df.select("l_orderkey", "l_linenumber", F.round(sum_of(*P.array_cols("v1-v2")), 6).alias("total"))


@q(
    "p25_default_var_list",
    "SELECT CAST(count(s_suppkey) AS BIGINT) AS n_s_suppkey, CAST(count(s_nationkey) AS BIGINT) AS n_s_nationkey, CAST(count(s_acctbal) AS BIGINT) AS n_s_acctbal FROM supplier"
)
def _(t):
    return A.means(t.supplier, numeric_cols(t.supplier), ["n"])


@q("a4_summary", "SELECT c_mktsegment, round(avg(c_acctbal), 6) AS mean_c_acctbal FROM customer GROUP BY 1")
def _(t):
    return A.summary(t.customer, "c_acctbal", ["mean"], "c_mktsegment").withColumn("mean_c_acctbal", F.round("mean_c_acctbal", 6))


@q(
    "a13_shape",
    "SELECT 'o_totalprice' AS variable, round(avg(pow(o_totalprice - m, 3)) / pow(avg(pow(o_totalprice - m, 2)), 1.5), 6) AS skewness, round(avg(pow(o_totalprice - m, 4)) / pow(avg(pow(o_totalprice - m, 2)), 2), 6) AS kurtosis FROM orders, (SELECT avg(o_totalprice) AS m FROM orders)"
)
def _(t):
    return A.univariate(t.orders, "o_totalprice").select("variable", F.round("skewness", 6).alias("skewness"), F.round("kurtosis", 6).alias("kurtosis"))


@q("w9_cumulative", "SELECT l_returnflag, CAST(sum(n) OVER (ORDER BY l_returnflag) AS BIGINT) AS cum_count FROM (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1)")
def _(t):
    return A.freq(t.lineitem, "l_returnflag").select("l_returnflag", "cum_count")


@q("o2_order_by_desc", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey")
def _(t):
    return W.sort(t.customer.select("c_custkey", "c_acctbal"), [("c_acctbal", True), "c_custkey"])


@q("u2_set_one", "SELECT * FROM nation")
def _(t):
    return J.set_(t.nation)


@q("d2_duration", "SELECT o_custkey, CAST(date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE) + 1 AS INTEGER) AS days FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b")).select("o_custkey", D.duration(F.col("a"), F.col("b")).alias("days"))


@q("d4_subject_id", "SELECT c_custkey, c_mktsegment || '-' || CAST(c_nationkey AS VARCHAR) || '-' || c_custkey AS usubjid FROM customer")
def _(t):
    return t.customer.select("c_custkey", D.subject_id("c_mktsegment", "c_nationkey", "c_custkey").alias("usubjid"))


@q("d6_population", "SELECT c_custkey FROM customer WHERE c_nationkey < 10")
def _(t):
    return D.population(t.customer.withColumn("ITTFL", F.when(F.col("c_nationkey") < 10, "Y").otherwise("N")), "ITTFL").select("c_custkey")


@q(
    "q22_decision",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 101 >= 90 THEN 'accepted' WHEN o_orderkey % 101 >= 70 THEN 'accepted_with_warning' WHEN o_orderkey % 101 >= 50 THEN 'needs_review' ELSE 'rejected' END AS decision FROM orders"
)
def _(t):
    return t.orders.select("o_orderkey", Q.decision(F.col("o_orderkey") % 101).alias("decision"))


@q(
    "k3_level",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 101 <= 20 THEN 'Basic' WHEN o_orderkey % 101 <= 40 THEN 'Simple' WHEN o_orderkey % 101 <= 60 THEN 'Intermediate' WHEN o_orderkey % 101 <= 80 THEN 'Advanced Clinical' ELSE 'Enterprise' END AS level_name FROM orders"
)
def _(t):
    return t.orders.select("o_orderkey", K.level_name(K.level(F.col("o_orderkey") % 101)).alias("level_name"))


@q(
    "k12_health",
    f"WITH {_E}, u AS ({_UP}), n AS (SELECT id, 100.0 * count(*) FILTER (WHERE dataset IN (SELECT dataset FROM u)) / count(*) AS h FROM x GROUP BY 1), d AS (SELECT i.id, coalesce(h, 100.0) AS h FROM (SELECT DISTINCT id FROM e) i LEFT JOIN n ON i.id = n.id) SELECT CASE WHEN h > 90 THEN 'Excellent' WHEN h > 75 THEN 'Good' WHEN h > 50 THEN 'Fair' ELSE 'Poor' END AS health, CAST(count(*) AS BIGINT) AS programs FROM d GROUP BY 1"
)
def _(t):
    return K.readiness(_edges(t), uploads(t)).groupBy("health").agg(F.count(F.lit(1)).alias("programs"))


_TOXIC = "SELECT CAST(toxic AS DOUBLE) AS y, CAST(n_chars AS DOUBLE) / 1000 AS x0, 1.0::DOUBLE AS x1 FROM labels JOIN documents USING (doc_id) WHERE toxic IS NOT NULL AND n_chars IS NOT NULL"


@q(
    "m6_odds_ratios",
    f"WITH d AS MATERIALIZED ({_TOXIC}), {solve_sql.logistic('d', 2)}, o AS (SELECT 'k' AS term, b0 AS b, sqrt(v0_0) AS s FROM b JOIN e USING (k) UNION ALL SELECT 'intercept', b1, sqrt(v1_1) FROM b JOIN e USING (k)) SELECT term, round(exp(b), 6) AS odds_ratio, round(exp(b - 1.959964 * s), 6) AS wald_low, round(exp(b + 1.959964 * s), 6) AS wald_high FROM o"
)
def _(t):
    df = t.labels.join(t.documents.select("doc_id", (F.col("n_chars") / 1000).alias("k")), "doc_id")
    return M.logistic(df, "toxic ~ k").select("term", *[F.round(c, 6).alias(c) for c in ("odds_ratio", "wald_low", "wald_high")])


@q(
    "m11_hazard_ratio",
    f"WITH s AS MATERIALIZED ({_COX.format(seg=1)}), {solve_sql.cox('s')} SELECT 'x' AS term, round(exp(b), 6) AS hazard_ratio, round(exp(b - 1.959964 / sqrt(h)), 6) AS wald_low, round(exp(b + 1.959964 / sqrt(h)), 6) AS wald_high FROM e"
)
def _(t):
    fit = M.cox(_surv(t).withColumn("x", F.col("c_acctbal") / 1000), "time", "event", "x").coefficients()
    return fit.select("term", *[F.round(c, 6).alias(c) for c in ("hazard_ratio", "wald_low", "wald_high")])
