"""Row-wise steps on streams: the data step's column expressions work on a streaming frame as they are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def stream_tables(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """New parquet files of a folder as a stream with the schema of ``like``."""
    return spark.readStream.schema(like.schema).parquet(folder)


def run_step(stream: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Apply a step to every micro-batch that is available now and append its rows to parquet files, exactly once."""
    return stream.transform(step).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
