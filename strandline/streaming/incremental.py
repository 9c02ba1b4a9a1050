"""Reports that arrive as files, handled as they come.

The operators are batch plans; a file stream runs them on each micro-batch, with the batch's number in the target path, so
that a batch that is run again after a failure replaces its own results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def watch_documents(spark: SparkSession, folder: str, glob: str = "*", files_per_batch: int = 1000) -> DataFrame:
    """A stream of path, content, one row per new file."""
    raw = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def run_incrementally(documents: DataFrame, plan: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Apply a plan to each micro-batch and write its result below target/batch=N."""

    def handle(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = documents.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
