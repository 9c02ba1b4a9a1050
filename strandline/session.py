"""Session and table helpers shared by every query."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "strandline") -> SparkSession:
    """A local session with adaptive execution on; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


#: Rows that go to a Python worker at a time: texts are long, and a batch is held several times over on its way.
BATCH_ROWS = 1_000


def share_package(spark: SparkSession) -> None:
    """Let Python workers find this package where it lies, if they don't already; clusters without shared files ship it instead."""
    root, environment = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


def short_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS where the session has Spark's own default."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a scale directory, read through Spark's own file system layer."""
    share_package(spark)
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
