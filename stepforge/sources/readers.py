"""Reading and writing tables: delimited text, statistical files, inline rows, libraries."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def read_csv(spark: SparkSession, path: str, schema: str | None = None, mode: str = "PERMISSIVE", limit: int | None = None) -> DataFrame:
    """Delimited text with a header; names lower-cased, types inferred unless a schema is given.

    ``mode="DROPMALFORMED"`` skips bad lines; ``limit`` takes a first sample only on request.
    """
    reader = spark.read.option("header", True).option("mode", mode)
    df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    return lower_names(df if limit is None else df.limit(limit))


def read_delim(spark: SparkSession, path: str, sep: str = "\t", schema: str | None = None) -> DataFrame:
    """Text with another delimiter."""
    reader = spark.read.option("header", True).option("sep", sep)
    return lower_names((reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path))


def _stat_files(spark: SparkSession, glob: str, kind: str, schema: str) -> DataFrame:
    """One task reads each file; the bytes come through Spark, so any store that Spark knows will do."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        for part in parts:
            for content in part["content"]:
                frame = pd.read_sas(io.BytesIO(content), format=kind, encoding="utf-8")
                yield frame.rename(columns=str.lower)

    files = spark.read.format("binaryFile").load(glob).select("path", "content")
    return files.select("content").mapInPandas(run, schema)


def read_sas(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """Many .sas7bdat files of one schema, a task for each."""
    return _stat_files(spark, glob, "sas7bdat", schema)


def read_xpt(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """Many XPORT files of one schema, a task for each."""
    return _stat_files(spark, glob, "xport", schema)


def sample(df: DataFrame, n: int | None = None, fraction: float | None = None, seed: int = 42, order_by=None, key: str | None = None) -> DataFrame:
    """The first n rows (of ``order_by``, where given), or a spread sample.

    With ``key`` the rows are drawn by a hash of that column: the same rows in every run, also where a part of it is run again.
    """
    from ..operators.rules import need_order

    if n is not None:
        return (df if order_by is None else df.orderBy(*need_order(order_by))).limit(n)
    if key is None:
        return df.sample(fraction=fraction, seed=seed)
    drawn = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")
    return df.where(drawn < int(fraction * 2**32))


def split_fields(df: DataFrame, columns: list[tuple[str, str]], text_col: str = "value") -> DataFrame:
    """Typed fields of blank-separated lines; '.' and missing fields are null, bad numbers too."""
    parts = F.split(F.trim(F.col(text_col)), r"\s+")
    out = []
    for i, (name, kind) in enumerate(columns):
        field = F.nullif(F.nullif(F.get(parts, F.lit(i)), F.lit(".")), F.lit(""))
        out.append((field.try_cast(kind) if kind != "string" else field).alias(name))
    return df.select("*", *out)


def inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table written in the program; short rows are padded with nulls."""
    from pyspark.sql.types import StructType

    width = len(StructType.fromDDL(schema))
    return spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], schema)


class Library:
    """A folder of tables: ``Library(spark, path).table(name)``."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "parquet"):
        self.spark, self.path, self.kind = spark, path.rstrip("/"), kind

    def table(self, name: str) -> DataFrame:
        path = f"{self.path}/{name.split('.')[-1].lower()}.{self.kind}"
        return self.spark.read.parquet(path) if self.kind == "parquet" else read_csv(self.spark, path)


class Catalog:
    """Named frames under the aliases short, lib.short and lib_short, lower-cased."""

    def __init__(self):
        self.frames: dict[str, DataFrame] = {}

    def register(self, name: str, df: DataFrame) -> None:
        lib, _, short = name.lower().rpartition(".")
        for alias in {short, f"{lib or 'work'}.{short}", f"{lib or 'work'}_{short}"}:
            self.frames[alias] = df

    def resolve(self, name: str) -> DataFrame:
        key = name.lower()
        stem = os.path.splitext(os.path.basename(key))[0]
        for k in (key, key.rpartition(".")[2], stem):
            if k in self.frames:
                return self.frames[k]
        raise KeyError(name)

    def aliases(self) -> list[str]:
        return sorted(self.frames)


def single_row(spark: SparkSession, **values) -> DataFrame:
    """One row made from assignments only, in the order given."""
    df = spark.range(1)
    for name, v in values.items():
        df = df.withColumn(name, v)
    return df.drop("id")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def preview(df: DataFrame, n: int, order_by) -> DataFrame:
    """The first n rows of a stated order."""
    from ..operators.rules import need_order

    return df.orderBy(*need_order(order_by)).limit(n)


def listing(df: DataFrame, vars: list[str], where=None, obs: int | None = None, order_by=None) -> DataFrame:
    """Chosen columns of chosen rows, numbered in a stated order; ``obs`` rows at most."""
    from ..operators.order import row_n
    from ..operators.rules import need_order

    keys = need_order(order_by)
    if where is not None:
        df = df.where(where)
    if obs is not None:
        df = df.orderBy(*keys).limit(obs)
    return row_n(df, order_by, "obs").select("obs", *vars)


def put_lines(df: DataFrame, parts: list, name: str = "line") -> DataFrame:
    """One log line a row: columns and literal texts joined by blanks."""
    return df.select("*", F.concat_ws(" ", *[F.col(p[1:]).cast("string") if p.startswith("@") else F.lit(p) for p in parts]).alias(name))


def file_integrity(spark: SparkSession, glob: str) -> DataFrame:
    """path, size, format, sha256, encoding and is_empty of each file."""
    files = spark.read.format("binaryFile").load(glob)
    text = F.decode(F.col("content"), "ISO-8859-1")
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    return files.select(
        "path", F.col("length").alias("size"), F.lower(F.element_at(F.split("path", r"\."), -1)).alias("format"), F.sha2("content", 256).alias("sha256"),
        F.when(valid, "utf-8").otherwise("latin-1").alias("encoding"), (F.length(F.trim(text)) == 0).alias("is_empty"),
    )
