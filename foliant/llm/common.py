"""Expressions and helpers that several operators share."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: White space and words as the operators define them.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_of(column: str) -> Column:
    """The text with null as the empty string."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else; texts without other letters take the fast built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """The array of words between white space, empty for a text without any."""
    return F.array_remove(F.split(text, SPACE + "+"), "")


def fixed(value: Column) -> Column:
    """``value``, which the optimizer then computes once a row where it stands.

    Filters that Spark infers or pushes down would otherwise copy the expression into lambdas, where it
    would run once per array element. The partition number is never negative but counts as non-deterministic.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_key(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``df`` as (doc_id, text, text_hash) for joins back to rows.

    Rows that agree in id and text have equal results, so both together serve as a key; a missing
    text counts as empty.
    """
    return df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names. A local default is set only where none is named and driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir("/tmp/checkpoints")
    return "file:///tmp/checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read from there, so that it is computed once and outlives executors."""
    spark = df.sparkSession
    folder = checkpoint_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def skewed_join(rows: DataFrame, labels: DataFrame, key: str, how: str = "inner", hot: int = 20_000) -> DataFrame:
    """``rows`` joined with ``labels`` (one row per ``key``), where some keys may hold a large share of ``rows``.

    Keys of more than ``hot`` rows, at most one in ``hot`` rows by their number, meet their labels by a broadcast;
    all others are dealt out by key. A null key has no label.
    """
    many = cut(rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > hot).where(F.col(key).isNotNull()).select(key))
    if not many.limit(1).count():
        return rows.join(labels, key, how)
    many = F.broadcast(many)
    cold = rows.join(many, key, "left_anti").join(labels, key, how)
    return cold.unionByName(rows.join(many, key, "left_semi").join(F.broadcast(labels.join(many, key, "left_semi")), key, how))


def most_frequent(counts: DataFrame, most: int) -> list[Row]:
    """Rows of the highest ``n``, the highest first: all from a count on, ``most`` rows at most.

    The count comes from a histogram over some thousand classes, so that no task sends more than these rows to the
    driver. ``counts`` (a name and n) is read twice and should be cut.
    """
    size = F.floor(F.log2("n") * 64)
    left, low = most, None
    for r in counts.groupBy(size.alias("size")).agg(F.count("*").alias("rows"), F.min("n").alias("n")).orderBy(F.desc("size")).collect():
        left -= r["rows"]
        if left < 0:
            break
        low = r["n"]
    return sorted(counts.where(F.col("n") >= low).collect(), key=lambda r: (-r["n"], r[0])) if low else []
