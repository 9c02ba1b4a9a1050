"""Jump consistent hashing of rows to shards, and their places inside them.

A row's shard follows from its key and the shard count alone: no ring table, no
coordination. With one more shard, 1/(n+1) of the rows move, all of them into
the new shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from strandline.llm._store import materialize, text_or_empty

#: Rows of one shard that are numbered together in one task, on average.
ROWS_PER_SUBSHARD = 50_000


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The jump consistent hash of unsigned 64-bit keys, all at once."""
    if shards < 1:
        raise ValueError("shards must be positive")
    keys = keys.astype(np.uint64, copy=True)
    at = np.zeros(len(keys), np.int64)
    jump = np.zeros(len(keys), np.int64)
    live = np.arange(len(keys))
    with np.errstate(over="ignore"):
        while len(live):
            at[live] = jump[live]
            k = keys[live] * np.uint64(2862933555777941757) + np.uint64(1)
            keys[live] = k
            jump[live] = ((at[live] + 1) * (float(1 << 31) / ((k >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
            live = live[jump[live] < shards]
    return at


def shard_of(key: Column, shards: int) -> Column:
    """Shard 0..shards-1 of a column of any type; its 64-bit hash is the key, null having one of its own."""

    @pandas_udf("int")
    def jump(hashes: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(hashes.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return jump(F.xxhash64(key))


def assign_shards(df: DataFrame, shards: int, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: the key, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 8 and text_crc32 its checksum; a null text counts as empty. law is 'key': key and
    shard count decide, so equal keys, null ones included, share a shard. slot counts from 0 without gaps in each shard,
    by sub-shard, key, checksum; repeated rows get slots of their own. grown_shard is the shard with one more of them.
    No task numbers a whole shard: each is cut into sub-shards by a hash of key and checksum, whose offsets come from
    their counts."""
    text = text_or_empty(text_col)
    row = df.select(
        F.col(key_col).alias(key_col),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = materialize(row.withColumns({"shard": shard_of(F.col(key_col), shards), "grown_shard": shard_of(F.col(key_col), shards + 1)}), "shards")
    subs = max(1, -(-placed.count() // (shards * ROWS_PER_SUBSHARD)))
    cut = placed.withColumn("_sub", F.pmod(F.xxhash64(key_col, "text_crc32"), F.lit(subs)).cast("int"))
    counts = cut.groupBy("shard", "_sub").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_sub", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("shard", "_sub").orderBy(F.col(key_col).asc_nulls_first(), "text_crc32", "size")
    return (
        cut.withColumn("_rank", F.row_number().over(inside))
        .join(offsets, ["shard", "_sub"])
        .select(key_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_before") + F.col("_rank") - 1).cast("long").alias("slot"), "grown_shard")
    )
