"""Running a stream to the end of its input, with its state and rows in the folder that the cluster shares."""

from __future__ import annotations

import re
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; only a local session may leave that unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = "file:///tmp/checkpoints"
    return f"{shared}/{name}-{uuid4().hex}"


def streamed(rows: DataFrame, to: str, state: str) -> StreamingQuery:
    """Starts ``rows`` over all input that there is now and writes them to Parquet in ``to``; run again with the same ``state``, it goes on where it ended."""
    return rows.writeStream.format("parquet").option("path", to).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
