"""Derivations of clinical reporting: study days, flags, populations, incidence tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import catx


def study_day(d: Column, ref: Column) -> Column:
    """Days from the reference date; there is no day 0."""
    return F.datediff(d, ref) + (F.to_date(d) >= F.to_date(ref)).cast("int")


def duration(start: Column, end: Column) -> Column:
    return F.datediff(end, start) + 1


def yes_no(c: Column) -> Column:
    """1 for Y, 0 for anything else that is not null."""
    return F.when(F.upper(c) == "Y", 1).when(c.isNotNull(), 0)


def subject_id(*parts, sep: str = "-") -> Column:
    return catx(sep, *parts)


def population(df: DataFrame, flag: str) -> DataFrame:
    return df.where(F.col(flag) == "Y")


def incidence(pop: DataFrame, events: DataFrame, arm: str, subject: str) -> DataFrame:
    """arm, n, events, subjects, percent, text and heading: event incidence by arm of a population; arms without events show zero.

    ``events`` has one row per event with the subject; rows of subjects outside the population are left out.
    """
    size = pop.groupBy(arm).agg(F.count_distinct(subject).alias("n"))
    hits = events.join(pop.select(subject, arm).distinct(), subject).groupBy(arm).agg(F.count(F.lit(1)).alias("events"), F.count_distinct(subject).alias("subjects"))
    out = size.join(hits, arm, "left").na.fill(0, ["events", "subjects"])
    out = out.withColumn("percent", F.round(100.0 * F.col("subjects") / F.col("n"), 1))
    text = F.concat(F.col("subjects").cast("string"), F.lit(" ("), F.format_string("%.1f", "percent"), F.lit("%)"))
    return out.withColumns({"text": text, "heading": F.concat(F.lit("(N="), F.col("n").cast("string"), F.lit(")"))})
