"""Transposition in both directions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rules import as_list


def transpose(df: DataFrame, by, id: str, var: str, prefix: str = "", values: list | None = None, check: bool = True) -> DataFrame:
    """Long to wide: one row per BY group, one column per ID value. A repeated ID within a group is an error.

    ``values`` saves the job that finds the ID values.
    """
    by = as_list(by)
    if check and df.groupBy(*by, id).count().where("count > 1").limit(1).count():
        raise ValueError("an ID value occurs twice in a BY group")
    wide = df.groupBy(*by).pivot(id, values).agg(F.first(var))
    return wide.withColumnsRenamed({c: f"{prefix}{c}" for c in wide.columns if c not in by})


def to_long(df: DataFrame, by, vars: list[str], name: str = "name", value: str = "value") -> DataFrame:
    """Wide to long."""
    return df.unpivot(as_list(by), vars, name, value)
