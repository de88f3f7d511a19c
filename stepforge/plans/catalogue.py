"""Registry of the library's queries: every one reads the given tables."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import combine, order, step, summary
from .registry import Tables

GROUPS = ["q_steps", "q_tables", "q_functions", "q_scalar", "q_quality", "q_programs", "q_models", "q_more"]


def _gather(what: str) -> dict:
    out: dict = {}
    for g in GROUPS:
        out |= getattr(importlib.import_module(f"{__package__}.{g}").R, what)
    return out


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge line items with their orders, derive revenue, class by quantity, describe by class, sort."""
    t = Tables(spark, sf_dir)
    items = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    merged = combine.merge(items, t.orders.select("o_orderkey", "o_orderstatus"), "o_orderkey", keep_if="a and b")
    n = F.col("l_quantity")
    derived = step.Step(merged).assign(revenue=F.col("l_extendedprice") * (1 - F.col("l_discount")), size=step.if_chain([(n < 10, "Low"), (n < 30, "Mid")], "High")).frame()
    stats = summary.means(derived, ["revenue"], ["n", "mean", "std", "min", "max", "median", "sum"], ["size"])
    rounded = stats.select("size", "n_revenue", *[F.round(c, 4).alias(c) for c in stats.columns[2:]])
    return order.sort(rounded, "size")


FLAGSHIP_SQL = """
WITH d AS (SELECT l_extendedprice * (1 - l_discount) AS revenue, CASE WHEN l_quantity < 10 THEN 'Low' WHEN l_quantity < 30 THEN 'Mid' ELSE 'High' END AS size
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT size, CAST(count(revenue) AS BIGINT) AS n_revenue, round(avg(revenue), 4) AS mean_revenue, round(stddev_samp(revenue), 4) AS std_revenue, round(min(revenue), 4) AS min_revenue,
       round(max(revenue), 4) AS max_revenue, round(median(revenue), 4) AS median_revenue, round(sum(revenue), 4) AS sum_revenue FROM d GROUP BY size"""


def queries() -> dict:
    return {"flagship_merge_means": flagship} | _gather("queries")


def oracle_sql() -> dict:
    return {"flagship_merge_means": FLAGSHIP_SQL} | _gather("sql")
