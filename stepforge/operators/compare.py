"""Comparison of tables and outputs, and scorecards over validation records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import NUMERIC, as_list

# Weights of the five categories.
WEIGHTS = {"structural": 0.20, "functional": 0.30, "statistical": 0.20, "execution": 0.15, "semantic": 0.15}


def compare_shape(a: DataFrame, b: DataFrame) -> DataFrame:
    """rows and columns of both, and whether they agree."""
    one = a.agg(F.count(F.lit(1)).alias("rows_a")).crossJoin(b.agg(F.count(F.lit(1)).alias("rows_b")))
    out = one.withColumns({"columns_a": F.lit(len(a.columns)), "columns_b": F.lit(len(b.columns))})
    return out.withColumn("equal", (F.col("rows_a") == F.col("rows_b")) & (F.col("columns_a") == F.col("columns_b")))


def agrees(a: Column, b: Column, tol: float = 1e-4) -> Column:
    """|a - b| <= tol * max(1, |a|); two nulls agree."""
    return F.coalesce(F.abs(a - b) <= tol * F.greatest(F.lit(1.0), F.abs(a)), a.isNull() & b.isNull())


def compare(a: DataFrame, b: DataFrame, keys, tol: float = 1e-4) -> DataFrame:
    """column, matched, differing, only_a, only_b: cells of the shared columns by key, in one join and one aggregate."""
    keys = as_list(keys)
    shared = [c for c in a.columns if c in b.columns and c not in keys]
    kinds = {f.name: f.dataType for f in a.schema.fields}
    left = a.select(*keys, F.lit(1).alias("__a"), *[F.col(c).alias(f"__a_{c}") for c in shared])
    right = b.select(*keys, F.lit(1).alias("__b"), *[F.col(c).alias(f"__b_{c}") for c in shared])
    both = left.join(right, keys, "full")
    in_both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    cells = []
    for c in shared:
        x, y = F.col(f"__a_{c}"), F.col(f"__b_{c}")
        same = agrees(x.cast("double"), y.cast("double"), tol) if isinstance(kinds[c], NUMERIC) else x.eqNullSafe(y)
        cells.append(
            F.struct(
                F.lit(c).alias("column"), F.count_if(in_both & same).alias("matched"), F.count_if(in_both & ~same).alias("differing"),
                F.count_if(F.col("__b").isNull()).alias("only_a"), F.count_if(F.col("__a").isNull()).alias("only_b")
            ).alias(f"__{c}")
        )
    return both.agg(*cells).select(F.inline(F.array(*[f"__{c}" for c in shared])))


def agreement(a: Column, b: Column, tol: float = 1e-4) -> list[Column]:
    """Aggregates match_percent and status (passed from 95 %)."""
    share = 100.0 * F.avg(agrees(a, b, tol).cast("int"))
    return [F.round(share, 4).alias("match_percent"), F.when(share >= 95, "passed").otherwise("warning").alias("status")]


NUMBER = r"-?[0-9]+(?:\.[0-9]+)?"


def numbers(df: DataFrame, id: str, text: str) -> DataFrame:
    """id, position, number: the numbers below 1e15 in a text, in order."""
    found = F.transform(F.regexp_extract_all(F.col(text), F.lit(NUMBER), F.lit(0)), lambda x: x.cast("double"))
    return df.select(F.col(id).alias("id"), F.posexplode(F.filter(found, lambda x: F.abs(x) < 1e15)).alias("position", "number"))


def text_agreement(a: DataFrame, b: DataFrame, id: str, text: str, first: int | None = None, tol: float = 1e-4, passed: float = 95, warning: float = 0) -> DataFrame:
    """id, pairs, match_percent, status of two text outputs, their numbers paired by position (the ``first`` k of them)."""
    x, y = numbers(a, id, text), numbers(b, id, text).withColumnRenamed("number", "other")
    if first is not None:
        x = x.where(F.col("position") < first)
    out = x.join(y, ["id", "position"]).groupBy("id").agg(F.count(F.lit(1)).alias("pairs"), (100.0 * F.avg(agrees(F.col("number"), F.col("other"), tol).cast("int"))).alias("p"))
    status = F.when(F.col("p") >= passed, "passed").when(F.col("p") >= warning, "warning").otherwise("failed")
    return out.select("id", "pairs", F.round("p", 4).alias("match_percent"), status.alias("status"))


def output_shapes(frames: dict[str, DataFrame]) -> DataFrame:
    """dataset, rows, columns of named frames."""
    parts = [df.agg(F.lit(k).alias("dataset"), F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns")) for k, df in frames.items()]
    return reduce(DataFrame.unionByName, parts)


def _earned() -> Column:
    return F.when(F.col("status") == "passed", F.col("impact")).when(F.col("status") == "warning", F.col("impact") * 0.5).otherwise(0.0)


def scorecard(scenarios: DataFrame, by=None) -> DataFrame:
    """category, score, passed, total for rows (category, status, impact); a category without rows scores 100."""
    by = as_list(by)
    got = scenarios.groupBy(*by, "category").agg(
        F.sum(_earned()).alias("e"), F.sum("impact").alias("i"), F.count_if(F.col("status") == "passed").alias("passed"), F.count(F.lit(1)).alias("total")
    )
    cats = F.explode(F.array(*map(F.lit, WEIGHTS))).alias("category")
    frame = scenarios.select(*by).distinct().select(*by, cats) if by else scenarios.sparkSession.range(1).select(cats)
    score = F.when(F.col("total").isNull(), 100.0).otherwise(F.round(F.coalesce(F.try_divide(100.0 * F.col("e"), "i"), F.lit(0.0)), 1))
    return frame.join(got, [*by, "category"], "left").select(
        *by, "category", score.alias("score"), F.coalesce("passed", F.lit(0)).alias("passed"), F.coalesce("total", F.lit(0)).alias("total")
    )


def overall(card: DataFrame, by=None) -> DataFrame:
    """overall and label of a scorecard."""
    weight = F.lit(0.0)
    for k, w in WEIGHTS.items():
        weight = F.when(F.col("category") == k, w).otherwise(weight)
    out = card.groupBy(*as_list(by)).agg(F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.sum(F.col("score") * weight))), 1).alias("overall"))
    return out.withColumn("label", F.when(F.col("overall") >= 90, "High").when(F.col("overall") >= 75, "Medium").otherwise("Low"))


def group_status(scenarios: DataFrame, by) -> DataFrame:
    """failed if any failed, warning if any warned, else completed."""
    s = F.col("status")
    return scenarios.groupBy(*as_list(by)).agg(F.when(F.bool_or(s == "failed"), "failed").when(F.bool_or(s == "warning"), "warning").otherwise("completed").alias("status"))


def filter_scenarios(scenarios: DataFrame, status: str | None = None, section: str | None = None, text: str | None = None) -> DataFrame:
    """section, count of the records that pass every filter given."""
    df = scenarios
    for col, value in (("status", status), ("section", section)):
        df = df if value is None else df.where(F.col(col) == value)
    df = df if text is None else df.where(F.contains(F.lower("message"), F.lit(text.lower())))
    return df.groupBy("section").agg(F.count(F.lit(1)).alias("count"))


def approval(issues: DataFrame, by) -> DataFrame:
    """approval of each group from its errors and warnings."""
    e, w = F.count_if(F.col("severity") == "error"), F.count_if(F.col("severity") == "warning")
    out = issues.groupBy(*as_list(by)).agg(e.alias("errors"), w.alias("warnings"))
    verdict = F.when((F.col("errors") == 0) & (F.col("warnings") == 0), "approved").when((F.col("errors") == 0) & (F.col("warnings") <= 2), "approved_with_warnings").when(F.col("errors") <= 1, "needs_review").otherwise("requires_revision")
    return out.withColumn("approval", verdict)
