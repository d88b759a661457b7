"""A corpus from raw documents to a mix: quality rules, near-duplicates, benchmark leaks, secrets, source weights."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import decontaminate, mixing, quality, secrets, simhash
from foliant.llm.common import checkpoint_dir
from foliant.sources import read_table


def _counted(docs: DataFrame) -> DataFrame:
    """``docs`` with n_chars counted again, where it is there."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line rules reject go; the others lose the lines that fail, and n_chars follows."""
    return _counted(quality.quality_filter(docs, clean=True))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark").select("item_id", "text"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; n_chars follows."""
    return _counted(secrets.mask_secrets(docs))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus with the number of copies that the mix takes of each document, which may be none, and its words."""
    return mixing.mix_corpus(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("mixing sources", source_mix),
]

#: The draw of the last stage and the components of the second are tested against brute force instead.
ORACLE_SQL = None


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the table documents.

    Each stage's result is a Parquet table in the shared folder, which goes when the next one is written; the last of
    them stays, as the returned rows are read from it. Nulls: a document without text fails the first stage, one without
    an id or a source passes like any other. Empty tables give no rows, columns beyond those of documents stay.
    """
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            _delete(spark, f"{folder}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
