"""Plans: what reaches the scan, and what is never in a plan."""

from pyspark.sql import functions as F

from stepforge.operators import combine, order, quality, step, summary
from stepforge.plans import catalogue


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def table(spark, tmp_path):
    spark.range(1000).select("id", (F.col("id") % 7).alias("g"), F.rand(1).alias("x"), F.lit("text").alias("s")).write.parquet(f"{tmp_path}/t")
    return spark.read.parquet(f"{tmp_path}/t")


def test_filter_and_columns_reach_the_scan(spark, tmp_path):
    df = step.Step(table(spark, tmp_path)).assign(y=F.col("x") * 2).subset(F.col("g") == 3).keep("id", "y").frame()
    p = plan(df)
    assert "EqualTo(g,3)" in p and "ReadSchema: struct<id:bigint,g:bigint,x:double>" in p


def test_one_pass_profiles(spark, tmp_path):
    df = table(spark, tmp_path)
    for out in (quality.missing_profile(df, True), summary.means(df, ["x"], ["n", "mean", "std"]), summary.corr_matrix(df, ["id", "g", "x"])):
        assert plan(out).count("FileScan") == 1


def test_keys_are_pruned_before_merges(spark, tmp_path):
    df = table(spark, tmp_path)
    p = plan(combine.orphans(df.select("id", "x"), df.select("id"), "id"))
    assert "s:string" not in p and "CartesianProduct" not in p


def test_first_k_is_not_a_full_sort(spark, tmp_path):
    assert "TakeOrderedAndProject" in plan(order.first_k(table(spark, tmp_path), 5, "x"))


def test_no_python_in_library_queries(spark):
    import os

    import pytest

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    for name in ("flagship_merge_means", "a1_means", "j6_merge_full", "w1_retain_sum", "q6_missing_profile", "k2_complexity", "k15_domain", "c2_compare_cells"):
        p = plan(catalogue.queries()[name](spark, "/root/testdata/sf0.001"))
        assert "Python" not in p and "Arrow" not in p and "Pandas" not in p, name
