"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths of the tables written and not deleted yet, oldest first.
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, set here only where it is unset and Spark runs on one machine."""
    key = "spark.checkpoint.dir"
    folder = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set(key, folder)
    return folder.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _written.remove(path)


def drop(*frames: DataFrame) -> None:
    """Delete tables that ``staged`` returned and that nothing reads any more; other frames are left alone."""
    for df in frames:
        if getattr(df, "staged_path", None) in _written:
            _delete(df.sparkSession, df.staged_path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end all tables staged in it but those passed to ``keep``, which it yields: write or collect the results inside."""
    before, kept = set(_written), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.staged_path)
        return df

    try:
        yield keep
    finally:
        for path in [p for p in _written if p not in before and p not in kept]:
            _delete(spark, path)
