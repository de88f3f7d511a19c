"""Queries: sources, the data step, user functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import order as W
from ..operators import step as P
from ..operators.storage import shared_dir
from ..sources import readers as S
from .registry import Registry

R = Registry()
q = R.query


@q("s1_csv_round_trip", "SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders")
def _(t):
    folder = f"{shared_dir(t.spark)}/orders-{uuid.uuid4().hex}"
    S.write_csv(t.orders.select(F.col("o_orderkey").alias("O_ORDERKEY"), "o_custkey", "o_orderstatus", "o_totalprice"), folder)
    df = S.read_csv(t.spark, folder, schema="o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double")
    return df.withColumn("o_totalprice", F.round("o_totalprice", 2))


@q(
    "s8_typed_input",
    "SELECT o_orderkey, CAST(o_orderkey AS DOUBLE) AS id, o_orderstatus AS st, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE round(o_totalprice, 2) END AS price, CAST(NULL AS VARCHAR) AS extra FROM orders"
)
def _(t):
    price = F.when(F.col("o_orderkey") % 5 == 0, F.lit(".")).otherwise(F.round("o_totalprice", 2).cast("string"))
    lines = t.orders.select("o_orderkey", F.concat_ws("  ", F.col("o_orderkey").cast("string"), "o_orderstatus", price).alias("value"))
    return S.split_fields(lines, [("id", "double"), ("st", "string"), ("price", "double"), ("extra", "string")]).drop("value")


@q("s9_library_table", "SELECT c_custkey, c_name FROM customer")
def _(t):
    return S.Library(t.spark, t.dir).table("work.Customer").select("c_custkey", "c_name")


@q("s10_catalog_alias", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(t):
    c = S.Catalog()
    c.register("Raw.Nation", t.nation)
    c.register("region", t.region)
    return c.resolve("raw_nation").join(c.resolve("WORK.region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@q("s11_single_row", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) * 2 AS BIGINT) AS twice, 'x' AS tag FROM orders")
def _(t):
    one = S.single_row(t.spark, tag=F.lit("x"))
    return t.orders.agg(F.count(F.lit(1)).alias("n")).withColumn("twice", F.col("n") * 2).crossJoin(F.broadcast(one))


@q("s13_preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10")
def _(t):
    return S.preview(t.orders, 10, "o_orderkey")


@q("s14_listing", "SELECT row_number() OVER (ORDER BY o_orderkey) AS obs, o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def _(t):
    return S.listing(t.orders, ["o_orderkey", "o_orderstatus"], where="o_orderstatus = 'F'", order_by="o_orderkey")


@q("s15_put_lines", "SELECT o_orderkey, concat_ws(' ', 'order', o_orderkey, 'is', o_orderstatus) AS line FROM orders")
def _(t):
    return S.put_lines(t.orders, ["order", "@o_orderkey", "is", "@o_orderstatus"]).select("o_orderkey", "line")


@q(
    "s16_file_integrity",
    "SELECT o_orderpriority, CAST(strlen(t) AS BIGINT) AS size, 'txt' AS format, sha256(t) AS sha256, 'utf-8' AS encoding, false AS is_empty FROM (SELECT o_orderpriority, string_agg(o_orderkey || chr(10), '' ORDER BY lpad(CAST(o_orderkey AS VARCHAR), 20, '0')) AS t FROM orders GROUP BY 1)"
)
def _(t):
    # a text file of the orders of each priority
    folder = f"{shared_dir(t.spark)}/priorities-{uuid.uuid4().hex}"
    lines = t.orders.select("o_orderpriority", F.col("o_orderkey").cast("string").alias("value"), F.lpad(F.col("o_orderkey").cast("string"), 20, "0").alias("at"))
    lines.repartition("o_orderpriority").sortWithinPartitions("o_orderpriority", "at").drop("at").write.partitionBy("o_orderpriority").text(folder)
    files = S.file_integrity(t.spark, f"{folder}/*/*.txt")
    return files.select(F.url_decode(F.regexp_extract("path", "o_orderpriority=([^/]*)", 1)).alias("o_orderpriority"), "size", "format", "sha256", "encoding", "is_empty")


@q(
    "p1_assign",
    "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS revenue, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 7) AS charge FROM lineitem"
)
def _(t):
    s = P.Step(t.lineitem).assign(revenue=F.col("l_extendedprice") * (1 - F.col("l_discount")), charge=F.col("revenue") * (1 + F.col("l_tax")))
    s = s.assign(revenue=F.round("revenue", 4), charge=F.round("charge", 7))
    return s.keep("l_orderkey", "l_linenumber", "revenue", "charge").frame()


@q("p2_keep_drop_rename", "SELECT o_orderkey AS id, o_custkey, o_orderdate FROM orders")
def _(t):
    return P.Step(t.orders).rename({"o_orderkey": "id"}).keep("id", "o_custkey", "o_orderdate", "o_orderstatus").drop("o_orderstatus", "absent").frame()


@q("p6_where", "SELECT o_orderkey FROM orders WHERE (CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END) > 100000")
def _(t):
    price = F.when(F.col("o_orderstatus") == "P", None).otherwise(F.col("o_totalprice"))
    return t.orders.where(price > 100000).select("o_orderkey")


@q("p7_subset_after_assign", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * l_discount, 4) AS cut FROM lineitem WHERE l_extendedprice * l_discount > 2000")
def _(t):
    s = P.Step(t.lineitem).assign(cut=F.col("l_extendedprice") * F.col("l_discount")).subset(F.col("cut") > 2000).assign(cut=F.round("cut", 4))
    return s.keep("l_orderkey", "l_linenumber", "cut").frame()


@q(
    "p8_if_chain",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN 'Low' WHEN l_quantity < 30 THEN 'Mid' ELSE 'High' END AS size, CASE WHEN l_quantity < 5 THEN 'tiny' END AS tiny FROM lineitem"
)
def _(t):
    n = F.col("l_quantity")
    return P.Step(t.lineitem).assign(
        size=P.if_chain([(n < 10, "Low"), (n < 30, "Mid")], "High"), tiny=P.if_chain([(n < 5, "tiny")])
    ).keep("l_orderkey", "l_linenumber", "size", "tiny").frame()


@q(
    "p9_if_do",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS done, CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE o_orderpriority END AS o_orderpriority FROM orders"
)
def _(t):
    return P.Step(t.orders).if_do(F.col("o_orderstatus") == "F", {"done": 1, "o_orderpriority": "closed"}, {"done": 0}).keep("o_orderkey", "done", "o_orderpriority").frame()


@q("p10_select_when", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'other' END AS word FROM orders")
def _(t):
    return t.orders.select("o_orderkey", P.select_when(F.col("o_orderstatus"), {"F": "final", "O": "open"}, "other").alias("word"))


@q("p11_ifn_ifc", "SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN 1 ELSE 0 END AS big, CASE WHEN o_orderstatus = 'F' THEN 'y' ELSE 'n' END AS f FROM orders")
def _(t):
    return t.orders.select("o_orderkey", P.ifn(F.col("o_totalprice") > 150000, 1, 0).alias("big"), P.ifc(F.col("o_orderstatus") == "F", "y", "n").alias("f"))


@q(
    "p12_comparisons",
    "SELECT CAST(count(*) FILTER (WHERE l_quantity = 10) AS BIGINT) AS eq, CAST(count(*) FILTER (WHERE l_quantity <> 10) AS BIGINT) AS ne, CAST(count(*) FILTER (WHERE l_quantity < 10 AND NOT l_tax >= 0.05) AS BIGINT) AS lt, CAST(count(*) FILTER (WHERE l_quantity BETWEEN 5 AND 7 OR l_returnflag IN ('R')) AS BIGINT) AS bt FROM lineitem"
)
def _(t):
    n = F.col("l_quantity")
    both = n.between(5, 7) | F.col("l_returnflag").isin("R")
    return t.lineitem.agg(F.count_if(n == 10).alias("eq"), F.count_if(n != 10).alias("ne"), F.count_if((n < 10) & ~(F.col("l_tax") >= 0.05)).alias("lt"), F.count_if(both).alias("bt"))


@q("p14_like", "SELECT p_partkey FROM part WHERE p_type LIKE '%A%' AND p_size IN (1, 2, 3)")
def _(t):
    return t.part.where(F.col("p_type").like("%A%") & F.col("p_size").isin(1, 2, 3)).select("p_partkey")


@q("p15_missing", "SELECT CAST(count(*) FILTER (WHERE l_linenumber = 3) AS BIGINT) AS n FROM lineitem")
def _(t):
    return t.lineitem.select(F.when(F.col("l_linenumber") != 3, F.col("l_discount")).alias("x")).agg(F.count_if(F.col("x").isNull()).alias("n"))


@q("p16_row_n", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS _n_ FROM orders")
def _(t):
    return W.row_n(t.orders.select("o_orderkey"), "o_orderkey")


@q("p17_nobs", "SELECT n_nationkey, (SELECT CAST(count(*) AS BIGINT) FROM nation) AS _nobs_ FROM nation")
def _(t):
    return P.with_nobs(t.nation.select("n_nationkey"))


_FOUR = "l_quantity AS x1, l_extendedprice AS x2, l_discount AS x3, l_tax AS x4"


def _four(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", *[F.col(c).alias(f"x{i + 1}") for i, c in enumerate(["l_quantity", "l_extendedprice", "l_discount", "l_tax"])])


@q("p19_array_constant", "SELECT l_orderkey, l_linenumber, 0 AS x1, 0 AS x2, 0 AS x3, 0 AS x4 FROM lineitem")
def _(t):
    return P.for_array(_four(t), P.array_cols("x1-x4"), 0)


@q("p20_array_expression", "SELECT l_orderkey, l_linenumber, round(l_quantity * 2, 4) AS x1, l_extendedprice AS x2, round(l_discount * 2 + 3, 4) AS x3, l_tax AS x4 FROM lineitem")
def _(t):
    df = P.for_array(_four(t), P.array_cols("x1-x4"), lambda c, i: F.round(c * 2 + (3 if i == 3 else 0), 4), 1, 4, 2)
    return df


@q(
    "p21_do_while",
    "SELECT o_orderkey, CAST(CASE WHEN o_totalprice >= 100000 THEN 0 ELSE ceil(log(100000 / o_totalprice) / log(1.5) - 1e-12) END AS BIGINT) AS years FROM orders WHERE o_totalprice > 0"
)
def _(t):
    start = F.struct(F.col("o_totalprice").alias("v"), F.lit(0).cast("bigint").alias("n"))
    grown = P.fold_while(start, lambda a: a["v"] < 100000, lambda a: F.struct((a["v"] * 1.5).alias("v"), (a["n"] + 1).alias("n")), 60)
    return t.orders.where("o_totalprice > 0").select("o_orderkey", grown["n"].alias("years"))


@q("p22_split_output", "SELECT 'big' AS dest, o_orderkey FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT 'final', o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def _(t):
    out = P.split_output(t.orders, {"big": F.col("o_totalprice") > 200000, "final": F.col("o_orderstatus") == "F"})
    a, b = (df.select(F.lit(k).alias("dest"), "o_orderkey") for k, df in out.items())
    return a.unionByName(b)


@q("p23_metadata", "SELECT o_orderkey, o_totalprice FROM orders")
def _(t):
    df = P.set_meta(t.orders, {"o_totalprice": {"label": "Total price", "format": "8.2"}})
    assert df.schema["o_totalprice"].metadata["label"] == "Total price"
    return df.select("o_orderkey", "o_totalprice")


@q("p24_format", "SELECT p_partkey, CASE WHEN p_size = 1 THEN 'one' WHEN p_size BETWEEN 2 AND 10 THEN 'few' WHEN p_size BETWEEN 11 AND 50 THEN 'many' ELSE 'other' END AS label FROM part")
def _(t):
    return P.apply_format(t.part, "p_size", {1: "one"}, "label", [(2, 10, "few"), (11, 50, "many")], "other").select("p_partkey", "label")


@q("p26_to_numeric", "SELECT p_partkey, try_cast(regexp_extract(p_brand, '[0-9]+$') AS DOUBLE) AS num, try_cast(p_name AS DOUBLE) AS bad FROM part")
def _(t):
    df = t.part.withColumn("tail", F.regexp_extract("p_brand", "[0-9]+$", 0))
    return df.select("p_partkey", P.to_numeric("tail").alias("num"), P.to_numeric("p_name").alias("bad"))


@q("p27_listwise", "SELECT CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_linenumber <> 3 AND l_returnflag <> 'R'")
def _(t):
    df = t.lineitem.select(F.when(F.col("l_linenumber") != 3, F.col("l_discount")).alias("a"), F.when(F.col("l_returnflag") != "R", F.col("l_tax")).alias("b"))
    return df.na.drop(subset=["a", "b"]).agg(F.count(F.lit(1)).alias("n"))


@q("p28_search", "SELECT n_nationkey FROM nation WHERE contains(lower(n_name), '1') OR contains(CAST(n_nationkey AS VARCHAR), '1') OR contains(CAST(n_regionkey AS VARCHAR), '1')")
def _(t):
    return P.search(t.nation, "1").select("n_nationkey")


@q("p29_page", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 50")
def _(t):
    return P.page(t.orders, "o_orderkey", 25, 2).select("o_orderkey")


@q("x1_user_function", "SELECT o_orderkey, round(o_totalprice * 0.9 + 5, 5) AS net FROM orders")
def _(t):
    net = P.define(lambda price, fee: F.round(price * 0.9 + fee, 5))
    return t.orders.select("o_orderkey", net("o_totalprice", 5).alias("net"))


@q("x2_step_macro", "SELECT o_orderstatus AS level, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1 UNION ALL SELECT o_orderpriority, count(*) FROM orders GROUP BY 1")
def _(t):
    def levels(df, var):
        return df.groupBy(F.col(var).alias("level")).agg(F.count(F.lit(1)).alias("n"))

    return t.orders.transform(levels, "o_orderstatus").unionByName(t.orders.transform(levels, "o_orderpriority"))


@q("x3_constants", "SELECT o_orderkey FROM orders WHERE o_totalprice > 250000 AND o_orderstatus = 'O'")
def _(t):
    return t.spark.sql("SELECT o_orderkey FROM {orders} WHERE o_totalprice > :low AND o_orderstatus = :st", args={"low": 250000, "st": "O"}, orders=t.orders)
