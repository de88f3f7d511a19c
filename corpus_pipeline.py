"""A training corpus in five stages, each an operator of ``stepforge.llm`` at work on all rows of its predecessor.

Language ID, SimHash near-dedup, benchmark decontamination, secret scans, best-fit packing. All but
the last return the columns of ``documents``; each result is written to the shared folder and read
again as the next stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepforge.llm import common, decontamination, language_id, near_copies, packing, secrets, simhash

#: Rows of a batch that goes to a Python worker: a batch holds whole texts, and these may be long.
BATCH_ROWS = 1000


def _bounded(spark: SparkSession) -> None:
    """This program's own setting for all its stages: small batches keep executors' memory low."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; the predicted language takes the place of a missing one.

    Texts without a letter go, and those that look like noise: more so than the labelled documents kept out of the training do.
    """
    _bounded(spark)
    taught = language_id.fold("doc_id", 5) != 0
    net = language_id.train(docs.where(taught), with_noise=True)
    limit = language_id.noise_limit(docs.where(~taught & F.col("lang").isNotNull()), net)
    return language_id.keep_known(docs, net, most_noise=limit)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest doc_id (null last), of these the first row.

    Near-duplicates: fingerprints within two bits, or sets of five-word shingles that agree to 0.8 or more.
    Rows are told apart by a number of their own, so those that share a doc_id, or have none, are linked by their texts alone.
    """
    _bounded(spark)
    row = common.new_name(docs, "row")
    numbered = common.staged(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    groups = simhash.near_duplicates(numbered, id_col=row, more=near_copies.links(numbered, id_col=row))
    rows = numbered.select(F.col(row).alias("doc_id"), F.col("doc_id").alias("id"))
    member = groups.join(rows, "doc_id").select("component_id", F.struct(F.isnull("id"), "id", F.col("doc_id").alias("row")).alias("m"))
    member = common.staged(member, "members")
    first = member.groupBy("component_id").agg(F.min("m").alias("first"))
    dropped = common.staged(member.join(first, "component_id").where("m > first").select(F.col("m.row").alias(row)), "dropped")
    return numbered.join(dropped, row, "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    _bounded(spark)
    return decontamination.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets and linked credentials replaced in their texts."""
    _bounded(spark)
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: bins of permitted lengths."""
    _bounded(spark)
    return packing.best_fit(docs).drop("row")


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("secret_scans", redact_secrets),
    ("best_fit_packing", pack_sequences),
]

#: Training, fingerprints by XXH64 and greedy tiling have no SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with common.scratch(spark) as keep:  # what the stage itself has written goes once its result is written
            docs = keep(common.staged(stage(spark, docs, sf_dir), name))
    return STAGES[-1][1](spark, docs, sf_dir)
