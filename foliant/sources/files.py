"""Readers of contracts in JSON, of append-only logs, and of folders of artifacts; all go through Spark's readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_contract(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """One row per JSON document of a folder: the columns of ``schema``, file and problem (null: valid).

    A document may spread over lines and a file may hold an array of them. What is not JSON or has a field of another type is ``corrupt``; a null in one of
    the ``required`` columns is named. Files below subfolders are read, too; an empty folder has no documents.
    """
    names = [f.name for f in StructType.fromDDL(schema)]
    raw = (
        spark.read.schema(f"{schema}, _corrupt string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
        .option("recursiveFileLookup", True).json(path)
    )
    missing = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]), lambda x: x.isNotNull())
    problem = F.when(F.col("_corrupt").isNotNull(), "corrupt").when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ",")))
    return raw.select(*names, F.col("_metadata.file_path").alias("file"), problem.alias("problem"))


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of append-only JSON lines with place, which orders them: by file name, then as they stand in the file. Blank lines are none; broken ones have problem set."""
    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("place"))
    parsed = lines.where(F.btrim("value") != "").withColumn("x", F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    return parsed.select("x.*", "place").withColumn("problem", F.when(F.col("_corrupt").isNotNull(), "corrupt")).drop("_corrupt")


def last_appended(log: DataFrame, key: str) -> DataFrame:
    """The last sound row of every key of ``read_log``; rows without a key are none. One aggregation, which gathers a row per key and task."""
    rows = log.where(F.col("problem").isNull() & F.col(key).isNotNull()).drop("problem")
    rest = [c for c in rows.columns if c not in (key, "place")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "place").alias("x")).select(key, "x.*")


def inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, name, bytes, modified) of the files below a folder whose names fit ``pattern``; their content is not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
