"""Parquet tables by name, read with Spark only so that any Hadoop-visible store works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A table of so many bytes that has fewer splits than there are cores is dealt out anew.
SPREAD_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the folder ``sf_dir``, one Parquet file or directory per table.

    A file with one row group cannot be split, and one core would do all the narrow work; only tables so small that
    they have fewer splits than cores are dealt out, so large ones are read as they lie.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution()
    if int(str(plan.optimizedPlan().stats().sizeInBytes())) < SPREAD_BYTES or plan.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)
