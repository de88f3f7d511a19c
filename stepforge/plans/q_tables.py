"""Queries: merges, set operations, summaries, ordered operators, transposition."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import combine as J
from ..operators import order as W
from ..operators import reshape as X
from ..operators import summary as A
from .registry import Registry

R = Registry()
q = R.query

# All customers and all totals, some under keys that the other side has not.
_A = "(SELECT CASE WHEN c_custkey % 3 = 0 THEN -c_custkey ELSE c_custkey END AS k, c_name, c_acctbal AS amount FROM customer)"
_B = "(SELECT CASE WHEN o_custkey % 2 = 0 THEN o_custkey ELSE -o_custkey - 1000000000 END AS k, CAST(count(*) AS BIGINT) AS orders, round(max(o_totalprice), 2) AS amount FROM orders GROUP BY 1)"


def _ab(t):
    ka, kb = F.col("c_custkey"), F.col("o_custkey")
    a = t.customer.select(F.when(ka % 3 == 0, -ka).otherwise(ka).alias("k"), "c_name", F.col("c_acctbal").alias("amount"))
    b = t.orders.groupBy(F.when(kb % 2 == 0, kb).otherwise(-kb - 1_000_000_000).alias("k")).agg(F.count(F.lit(1)).alias("orders"), F.round(F.max("o_totalprice"), 2).alias("amount"))
    return a, b


@q("j1_merge_left", f"SELECT k, a.c_name, CASE WHEN b.k IS NOT NULL THEN b.amount ELSE a.amount END AS amount, orders FROM {_A} a LEFT JOIN {_B} b USING (k)")
def _(t):
    return J.merge(*_ab(t), "k")


@q("j1_merge_suffixes", f"SELECT k, a.c_name, a.amount AS \"amount.x\", b.amount AS \"amount.y\", orders FROM {_A} a JOIN {_B} b USING (k)")
def _(t):
    return J.merge(*_ab(t), "k", keep_if="a and b", overlay=False)


@q("j2_merge_if_a", f"SELECT k, c_name, orders FROM {_A} a LEFT JOIN {_B} b USING (k)")
def _(t):
    return J.merge(*_ab(t), "k", keep_if="a").drop("amount")


@q("j3_merge_if_a_and_b", f"SELECT k, c_name, b.amount AS amount, orders FROM {_A} a JOIN {_B} b USING (k)")
def _(t):
    return J.merge(*_ab(t), "k", keep_if="a and b")


@q("j4_merge_if_not_b", f"SELECT * FROM {_A} a WHERE NOT EXISTS (SELECT 1 FROM {_B} b WHERE a.k = b.k)")
def _(t):
    return J.merge(*_ab(t), "k", keep_if="not b")


@q("j4_merge_if_not_a", f"SELECT * FROM {_B} b WHERE NOT EXISTS (SELECT 1 FROM {_A} a WHERE a.k = b.k)")
def _(t):
    return J.merge(*_ab(t), "k", keep_if="not a")


@q("j5_in_flags", f"SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 0 ELSE 1 END AS ina, CASE WHEN b.k IS NULL THEN 0 ELSE 1 END AS inb FROM {_A} a FULL JOIN {_B} b ON a.k = b.k")
def _(t):
    return J.merge(*_ab(t), "k", how="full", flags=("ina", "inb")).select("k", "ina", "inb")


@q("j6_merge_full", f"SELECT coalesce(a.k, b.k) AS k, c_name, CASE WHEN b.k IS NOT NULL THEN b.amount ELSE a.amount END AS amount, orders FROM {_A} a FULL JOIN {_B} b ON a.k = b.k")
def _(t):
    return J.merge(*_ab(t), "k", how="full")


@q("j7_sql_join", "SELECT c_name, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE c_acctbal > 5000")
def _(t):
    return J.sql_join(t.customer, t.orders, [("c_custkey", "o_custkey")], "left", ["a.c_name", "b.o_orderkey"], "a.c_acctbal > 5000")


@q("j7_sql_join_right", "SELECT s_name, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey")
def _(t):
    return J.sql_join(t.supplier, t.nation, [("s_nationkey", "n_nationkey")], "right", ["a.s_name", "b.n_name"])


@q("j8_cross_join", "SELECT r_name, n_name FROM region CROSS JOIN nation")
def _(t):
    return t.region.select("r_name").crossJoin(t.nation.select("n_name"))


@q("j9_lookup", "SELECT c_custkey, n_name, n_regionkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def _(t):
    ref = t.nation.withColumnRenamed("n_nationkey", "c_nationkey")
    return J.lookup(t.customer, ref, "c_nationkey", ["n_name", "n_regionkey"]).select("c_custkey", "n_name", "n_regionkey")


_TRANS = "(SELECT c_custkey + 40 AS c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'T' || c_name END AS c_name, c_nationkey FROM customer)"


def _trans(t):
    return t.customer.select((F.col("c_custkey") + 40).alias("c_custkey"), F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit("T"), "c_name")).alias("c_name"), "c_nationkey")


@q(
    "j10_update",
    f"SELECT coalesce(m.c_custkey, t.c_custkey) AS c_custkey, coalesce(t.c_name, m.c_name) AS c_name, coalesce(t.c_nationkey, m.c_nationkey) AS c_nationkey, c_acctbal, c_mktsegment FROM customer m FULL JOIN {_TRANS} t ON m.c_custkey = t.c_custkey"
)
def _(t):
    return J.update(t.customer, _trans(t), "c_custkey")


@q(
    "j11_modify",
    f"SELECT m.c_custkey, coalesce(t.c_name, m.c_name) AS c_name, coalesce(t.c_nationkey, m.c_nationkey) AS c_nationkey, c_acctbal, c_mktsegment FROM customer m LEFT JOIN {_TRANS} t ON m.c_custkey = t.c_custkey"
)
def _(t):
    return J.modify(t.customer, _trans(t), "c_custkey")


@q(
    "j12_merge_many",
    "SELECT c_nationkey AS k, c.n AS customers, s.n AS suppliers, n_name FROM (SELECT c_nationkey, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY 1) c LEFT JOIN (SELECT s_nationkey, CAST(count(*) AS BIGINT) AS n FROM supplier GROUP BY 1) s ON c_nationkey = s_nationkey LEFT JOIN nation ON c_nationkey = n_nationkey"
)
def _(t):
    a = t.customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    b = t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    return J.merge_all([a, b, t.nation.select(F.col("n_nationkey").alias("k"), "n_name")], "k")


def _parents(t):
    """All orders, one in eleven under a key that no line has."""
    k = F.col("o_orderkey")
    return t.orders.select(F.when(k % 11 == 0, -k - 1).otherwise(k).alias("l_orderkey"))


@q(
    "j13_orphans",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT CASE WHEN o_orderkey % 11 = 0 THEN -o_orderkey - 1 ELSE o_orderkey END FROM orders)"
)
def _(t):
    return J.orphans(t.lineitem, _parents(t), "l_orderkey").select("l_orderkey", "l_linenumber", "l_quantity")


@q(
    "j13_integrity_score",
    "SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE l_orderkey % 11 <> 0) AS BIGINT) AS matched, round(100.0 * count(*) FILTER (WHERE l_orderkey % 11 <> 0) / count(*), 4) AS score FROM lineitem"
)
def _(t):
    return J.integrity_score(t.lineitem, _parents(t), "l_orderkey")


@q("u1_set", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def _(t):
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return J.set_(a, t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))


@q("u3_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def _(t):
    return J.union_distinct(t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select("s_nationkey"))


@q("u4_remove_duplicates", "SELECT DISTINCT o_custkey, o_orderstatus FROM orders UNION SELECT o_custkey, CASE WHEN o_orderkey % 10 = 0 THEN 'again' ELSE o_orderstatus END FROM orders")
def _(t):
    df = t.orders.select("o_custkey", "o_orderstatus")
    return W.dedup(df.unionByName(t.orders.select("o_custkey", F.when(F.col("o_orderkey") % 10 == 0, "again").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))))


@q("u4_first_by_key", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def _(t):
    return W.dedup(t.orders.select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@q("u5_difference", "SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(t):
    return J.difference(t.customer, t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@q("u6_intersection", "SELECT DISTINCT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def _(t):
    return J.intersection(t.customer, t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


def _r(df, *keep):
    """Floats to 6 digits, for comparison across engines."""
    return df.select(*[F.round(c, 6).alias(c) if k in ("double", "float") and c not in keep else F.col(c) for c, k in df.dtypes])


@q(
    "a1_means",
    "SELECT CAST(count(l_quantity) AS BIGINT) AS n_l_quantity, round(avg(l_quantity), 6) AS mean_l_quantity, round(stddev_samp(l_quantity), 6) AS std_l_quantity, min(l_quantity) AS min_l_quantity, max(l_quantity) AS max_l_quantity, median(l_quantity) AS median_l_quantity, round(var_samp(l_quantity), 6) AS var_l_quantity, round(sum(l_quantity), 6) AS sum_l_quantity, CAST(0 AS BIGINT) AS nmiss_l_quantity FROM lineitem"
)
def _(t):
    return _r(A.means(t.lineitem, "l_quantity", ["n", "mean", "std", "min", "max", "median", "var", "sum", "nmiss"]))


@q(
    "a2_means_class",
    "SELECT l_returnflag, l_linestatus, CAST(count(l_discount) AS BIGINT) AS n_l_discount, round(avg(l_discount), 6) AS mean_l_discount, round(stddev_samp(l_tax), 6) AS std_l_tax, CAST(count(l_tax) AS BIGINT) AS n_l_tax, round(avg(l_tax), 6) AS mean_l_tax, round(stddev_samp(l_discount), 6) AS std_l_discount FROM lineitem GROUP BY ALL"
)
def _(t):
    return _r(A.means(t.lineitem, ["l_discount", "l_tax"], ["n", "mean", "std"], ["l_returnflag", "l_linestatus"]))


@q(
    "a2_means_missing_level",
    "SELECT CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS st, CAST(count(*) AS BIGINT) AS n_o_totalprice, round(avg(o_totalprice), 6) AS mean_o_totalprice FROM orders GROUP BY 1"
)
def _(t):
    df = t.orders.withColumn("st", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")))
    return _r(A.means(df, "o_totalprice", ["n", "mean"], "st", missing=True))


@q(
    "a3_more_statistics",
    "SELECT l_returnflag, round(quantile_cont(l_quantity, 0.25), 6) AS q1_l_quantity, round(quantile_cont(l_quantity, 0.75), 6) AS q3_l_quantity, round(stddev_samp(l_quantity) / sqrt(count(l_quantity)), 6) AS stderr_l_quantity, round(100 * stddev_samp(l_quantity) / avg(l_quantity), 6) AS cv_l_quantity, max(l_quantity) - min(l_quantity) AS range_l_quantity FROM lineitem GROUP BY 1"
)
def _(t):
    return _r(A.means(t.lineitem, "l_quantity", ["q1", "q3", "stderr", "cv", "range"], "l_returnflag"))


@q(
    "a3_mode",
    "SELECT l_returnflag, min(l_quantity) AS mode_l_quantity FROM (SELECT l_returnflag, l_quantity, rank() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC) AS r FROM lineitem GROUP BY 1, 2) WHERE r = 1 GROUP BY 1"
)
def _(t):
    return A.means(t.lineitem, "l_quantity", ["mode"], "l_returnflag")


@q(
    "a5_means_long",
    "SELECT * FROM (SELECT 'l_quantity' AS variable, CAST(count(*) AS DOUBLE) AS n, round(avg(l_quantity), 6) AS mean FROM lineitem UNION ALL SELECT 'l_tax', CAST(count(*) AS DOUBLE), round(avg(l_tax), 6) FROM lineitem)"
)
def _(t):
    return _r(A.means_long(t.lineitem.withColumn("gone", F.lit(None).cast("double")), ["l_quantity", "l_tax", "gone"], ["n", "mean"]))


_FREQ = "SELECT o_orderpriority, n AS count, round(100.0 * n / t, 6) AS percent, CAST(sum(n) OVER (ORDER BY o_orderpriority) AS BIGINT) AS cum_count, round(100.0 * sum(n) OVER (ORDER BY o_orderpriority) / t, 6) AS cum_percent FROM (SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1), (SELECT count(*) AS t FROM orders)"


@q("a6_freq", _FREQ)
def _(t):
    return _r(A.freq(t.orders, "o_orderpriority"))


@q(
    "a7_freq_two_way",
    "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS count, round(100.0 * count(*) / (SELECT count(*) FROM lineitem), 6) AS percent FROM lineitem GROUP BY 1, 2"
)
def _(t):
    return _r(A.freq(t.lineitem, ["l_returnflag", "l_linestatus"]))


@q("a8_freq_out", "SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS count FROM customer GROUP BY 1")
def _(t):
    return A.freq_out(t.customer, "c_mktsegment")


@q(
    "a9_crosstab",
    "SELECT l_returnflag, CAST(count(*) FILTER (WHERE l_linestatus = 'F') AS BIGINT) AS F, CAST(count(*) FILTER (WHERE l_linestatus = 'O') AS BIGINT) AS O FROM lineitem GROUP BY 1"
)
def _(t):
    return A.crosstab(t.lineitem, "l_returnflag", "l_linestatus", ["F", "O"])


@q(
    "a10_tabulate",
    "SELECT 'o_orderstatus' AS variable, o_orderstatus AS level, o_orderpriority AS \"group\", count(*) || ' (' || printf('%.1f', round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority), 1)) || '%)' AS text FROM orders GROUP BY 2, 3 UNION ALL SELECT 'o_custkey', NULL, o_orderpriority, printf('%.1f (%.1f, %.1f)', round(quantile_cont(o_custkey, 0.5), 1), round(quantile_cont(o_custkey, 0.25), 1), round(quantile_cont(o_custkey, 0.75), 1)) FROM orders GROUP BY 3"
)
def _(t):
    return A.tabulate(t.orders, "o_orderpriority", ["o_custkey"], ["o_orderstatus"])


@q("a11_report", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def _(t):
    return A.report(t.orders, ["o_orderkey", "o_totalprice"], "o_orderstatus = 'F'")


@q("a12_univariate", """SELECT 'l_quantity' AS variable, CAST(min(l_quantity) AS DOUBLE) AS min, quantile_cont(l_quantity, 0.25) AS q1, median(l_quantity) AS median, round(avg(l_quantity), 6) AS mean, quantile_cont(l_quantity, 0.75) AS q3, CAST(max(l_quantity) AS DOUBLE) AS max, CAST(0 AS BIGINT) AS nmiss,
 round(avg(pow(l_quantity - m, 3)) / pow(avg(pow(l_quantity - m, 2)), 1.5), 6) AS skewness, round(avg(pow(l_quantity - m, 4)) / pow(avg(pow(l_quantity - m, 2)), 2), 6) AS kurtosis FROM lineitem, (SELECT avg(l_quantity) AS m FROM lineitem)""")
def _(t):
    return _r(A.univariate(t.lineitem, "l_quantity"))


@q(
    "a14_normality",
    "SELECT n, round(n / 6.0 * (s * s + k * k / 4), 4) AS jb, round(exp(-n / 12.0 * (s * s + k * k / 4)), 6) AS p_value FROM (SELECT CAST(count(*) AS BIGINT) AS n, avg(pow(c_acctbal - m, 3)) / pow(avg(pow(c_acctbal - m, 2)), 1.5) AS s, avg(pow(c_acctbal - m, 4)) / pow(avg(pow(c_acctbal - m, 2)), 2) - 3 AS k FROM customer, (SELECT avg(c_acctbal) AS m FROM customer))"
)
def _(t):
    return A.normality(t.customer, "c_acctbal").select("n", F.round("jb", 4).alias("jb"), F.round("p_value", 6).alias("p_value"))


_V = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS var1, '{b}' AS var2, round(corr({a}, {b}), 4) AS r FROM lineitem" for a in _V for b in _V)


@q("a15_corr", _PAIRS)
def _(t):
    return A.corr_matrix(t.lineitem, _V)


@q(
    "a16_corr_tests",
    "SELECT 'l_quantity' AS var1, 'l_extendedprice' AS var2, CAST(count(*) AS BIGINT) AS n, round(corr(l_quantity, l_extendedprice), 6) AS r, round(corr(l_quantity, l_extendedprice) * sqrt((count(*) - 2) / (1 - pow(corr(l_quantity, l_extendedprice), 2))), 4) AS t FROM lineitem"
)
def _(t):
    return A.corr_tests(t.lineitem, ["l_quantity", "l_extendedprice"]).select("var1", "var2", "n", F.round("r", 6).alias("r"), F.round("t", 4).alias("t"))


@q(
    "a17_sql_aggregates",
    "SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders GROUP BY 1"
)
def _(t):
    return t.orders.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.round(F.avg("o_totalprice"), 4).alias("mean"),
        F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last")
    )


@q("a18_count_distinct", "SELECT l_returnflag, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS suppliers FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.count_distinct("l_suppkey").alias("suppliers"))


@q("a19_scalar", "SELECT o_orderkey, round(o_totalprice / m, 6) AS share FROM orders, (SELECT max(o_totalprice) AS m FROM orders)")
def _(t):
    df = A.with_scalar(t.orders, A.scalar(t.orders, F.max("o_totalprice"), "m"))
    return df.select("o_orderkey", F.round(F.col("o_totalprice") / F.col("m"), 6).alias("share"))


@q("a20_top_groups", "SELECT o_custkey, CAST(count(*) AS BIGINT) AS count FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(t):
    return A.top_groups(t.orders, "o_custkey", 10)


@q(
    "a21_kpis",
    "SELECT CAST(count(*) FILTER (WHERE event_type = 'click') AS BIGINT) AS clicks, CAST(count(*) FILTER (WHERE value > 50) AS BIGINT) AS big, round(avg(value), 6) AS mean FROM events"
)
def _(t):
    return _r(A.kpis(t.events, {"clicks": F.col("event_type") == "click", "big": F.col("value") > 50}, {"mean": F.col("value")}))


@q("a22_success_rate", "SELECT round(100 * avg(quality), 2) AS success_rate FROM labels")
def _(t):
    return A.success_rate(t.labels, F.col("quality"))


@q(
    "a23_severity_counts",
    "SELECT o_custkey, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS F, CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS BIGINT) AS O FROM orders GROUP BY 1"
)
def _(t):
    return A.severity_counts(t.orders, "o_custkey", "o_orderstatus", ["F", "O"])


@q("a24_having", "SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n > 12")


_ISSUES = "SELECT l_orderkey, CAST(count(*) FILTER (WHERE l_tax > 0.05) AS BIGINT) AS tax, CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS BIGINT) AS returned FROM lineitem GROUP BY 1"


@q("a25_issue_list", f"WITH d AS ({_ISSUES}) SELECT l_orderkey, 'tax' AS issue, tax AS n FROM d WHERE tax > 0 UNION ALL SELECT l_orderkey, 'returned', returned FROM d WHERE returned > 0")
def _(t):
    d = t.lineitem.groupBy("l_orderkey").agg(F.count_if(F.col("l_tax") > 0.05).alias("tax"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    return A.issue_list(d, "l_orderkey", ["tax", "returned"])


_EV = "PARTITION BY user_id ORDER BY ts, event_id"
_VAL = "CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END"


def _events(t):
    return t.events.select("event_id", "ts", "user_id", "value", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("x"))


_KEY = ["ts", "event_id"]


@q("w1_retain_sum", f"SELECT event_id, round(100 + coalesce(sum({_VAL}) OVER ({_EV} ROWS UNBOUNDED PRECEDING), 0), 6) AS total FROM events")
def _(t):
    return _r(W.retain_sum(_events(t), "x", "user_id", _KEY, init=100).select("event_id", "total"))


@q("w2_carry_forward", f"SELECT event_id, last_value({_VAL} IGNORE NULLS) OVER ({_EV} ROWS UNBOUNDED PRECEDING) AS y FROM events")
def _(t):
    return W.carry_forward(_events(t), "x", "user_id", _KEY, "y").select("event_id", "y")


@q("w3_running_min_max", f"SELECT event_id, min(value) OVER ({_EV} ROWS UNBOUNDED PRECEDING) AS low, max(value) OVER ({_EV} ROWS UNBOUNDED PRECEDING) AS high FROM events")
def _(t):
    return W.running(_events(t), "value", "user_id", _KEY).select("event_id", "low", "high")


@q("w4_lag", f"SELECT event_id, lag(value, 2) OVER ({_EV}) AS lag FROM events")
def _(t):
    return W.lag(_events(t), "value", "user_id", _KEY, 2).select("event_id", "lag")


@q("w5_dif", f"SELECT event_id, round(value - lag(value) OVER ({_EV}), 6) AS dif FROM events")
def _(t):
    return _r(W.dif(_events(t), "value", "user_id", _KEY).select("event_id", "dif"))


@q(
    "w6_first_last",
    f"SELECT event_id, CASE WHEN row_number() OVER ({_EV}) = 1 THEN 1 ELSE 0 END AS is_first, CASE WHEN lead(1) OVER ({_EV}) IS NULL THEN 1 ELSE 0 END AS is_last FROM events"
)
def _(t):
    return W.first_last(_events(t), "user_id", _KEY).select("event_id", "is_first", "is_last")


@q("w7_sequence", f"SELECT event_id, row_number() OVER ({_EV}) AS seq FROM events")
def _(t):
    return W.sequence_in(_events(t), "user_id", _KEY).select("event_id", "seq")


@q("w8_table_sequence", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS _n_ FROM events")
def _(t):
    return W.row_n(t.events.select("event_id", "ts"), _KEY).select("event_id", "_n_")


@q(
    "w10_locf_nocb",
    f"SELECT event_id, last_value({_VAL} IGNORE NULLS) OVER ({_EV} ROWS UNBOUNDED PRECEDING) AS locf, first_value({_VAL} IGNORE NULLS) OVER ({_EV} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nocb FROM events"
)
def _(t):
    df = W.carry_forward(_events(t), "x", "user_id", _KEY, "locf")
    return W.carry_backward(df, "x", "user_id", _KEY, "nocb").select("event_id", "locf", "nocb")


_ORD = "PARTITION BY user_id ORDER BY event_id"
_UP, _DN = f"({_ORD} ROWS UNBOUNDED PRECEDING)", f"({_ORD} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@q("w11_interpolate", f"""WITH d AS (SELECT *, {_VAL} AS x, CASE WHEN event_id % 3 <> 0 THEN event_id END AS k FROM events),
e AS (SELECT event_id, x, last_value(x IGNORE NULLS) OVER {_UP} AS x0, first_value(x IGNORE NULLS) OVER {_DN} AS x1, last_value(k IGNORE NULLS) OVER {_UP} AS t0, first_value(k IGNORE NULLS) OVER {_DN} AS t1 FROM d)
SELECT event_id, round(coalesce(x, x0 + (x1 - x0) * (event_id - t0) / (t1 - t0)), 6) AS y FROM e""")
def _(t):
    return _r(W.interpolate(_events(t), "x", "event_id", "user_id", "y").select("event_id", "y"))


@q("w12_by_group_step", "SELECT user_id, CAST(count(*) AS BIGINT) AS n_value, round(avg(value), 6) AS mean_value FROM events GROUP BY 1")
def _(t):
    return _r(A.means(t.events, "value", ["n", "mean"], "user_id"))


@q("o1_sort", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS st FROM orders ORDER BY st DESC NULLS LAST, o_orderkey")
def _(t):
    df = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("st"))
    return W.sort(df, [("st", True), "absent", "o_orderkey"])


@q("o3_most_recent", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def _(t):
    return W.first_k(t.orders.select("o_orderkey", "o_orderdate"), 20, [("o_orderdate", True), "o_orderkey"])


@q(
    "r1_transpose",
    "SELECT l_returnflag, round(sum(l_quantity) FILTER (WHERE l_linestatus = 'F'), 4) AS st_F, round(sum(l_quantity) FILTER (WHERE l_linestatus = 'O'), 4) AS st_O FROM lineitem GROUP BY 1"
)
def _(t):
    long = t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 4).alias("qty"))
    return X.transpose(long, "l_returnflag", "l_linestatus", "qty", "st_", ["F", "O"])


@q("r2_to_long", "SELECT l_orderkey, l_linenumber, 'l_discount' AS name, l_discount AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem")
def _(t):
    return X.to_long(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"])
