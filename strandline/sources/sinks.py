"""Sinks: partitioned tables for results, and small documents written whole."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from pyspark.sql import DataFrame


def write_results(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Results as Parquet, one folder per value of the partition columns; a later run of a partition replaces it alone."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_documents(df: DataFrame, path: str) -> None:
    """Results as JSON lines."""
    df.write.mode("overwrite").json(path)


def write_manifest(path: str, payload: dict) -> None:
    """A small driver-side document, visible only once it is complete."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    partial = os.path.join(folder, f".{uuid.uuid4().hex}")
    with open(partial, "w", encoding="utf-8") as f:
        json.dump(payload, f, ensure_ascii=False, indent=2, sort_keys=True)
    os.replace(partial, path)


def scratch(prefix: str = "strandline-") -> str:
    """A local folder of one driver, for tests and single machines."""
    return tempfile.mkdtemp(prefix=prefix)
