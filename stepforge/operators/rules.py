"""House rules: explicit order, null placement, column checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def as_list(x) -> list:
    return [] if x is None else [x] if isinstance(x, (str, Column)) else list(x)


def need_order(order_by) -> list[Column]:
    """Sort keys as columns, nulls last; order-dependent operators refuse to work without them."""
    keys = as_list(order_by)
    if not keys:
        raise ValueError("this operator depends on row order: give order_by")
    return [sort_key(k) for k in keys]


def sort_key(key, sas_order: bool = False) -> Column:
    """A name, a Column or (name, descending) as a sort column; ``sas_order`` puts missing lowest."""
    if isinstance(key, Column):
        return key
    name, desc = (key, False) if isinstance(key, str) else key
    c = F.col(name)
    if sas_order:
        return c.desc_nulls_last() if desc else c.asc_nulls_first()
    return c.desc_nulls_last() if desc else c.asc_nulls_last()


def numeric_cols(df: DataFrame) -> list[str]:
    """Names of the numeric columns: the default VAR list."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def type_class(dtype: T.DataType) -> str:
    if isinstance(dtype, NUMERIC):
        return "numeric"
    return "datetime" if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "character"


def existing(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Those of ``names`` that the frame has, in the frame's own case."""
    have = {c.lower(): c for c in df.columns}
    return [have[n.lower()] for n in names if n.lower() in have]
