"""Intermediate tables in the folder that all executors share, and joins that hot keys and long row lists can't hurt."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: 64-bit words of a sieve: what is broadcast is never more than these, about 5 MB.
SIEVE_WORDS = 1 << 17
#: Short rows in a file of a table whose size is known.
FILE_ROWS = 1_000_000
#: A key is heavy if it holds more than one in so many rows, so there are fewer heavy keys than this.
HEAVY_KEYS = 1_000


def shared_root(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a local session without one (tests) gets an own folder, any other is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="strandline-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def materialize(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends, a lost executor costs nothing. Where it is
    known to have about so many short rows, it is written to as few files as these need."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(1 + rows // FILE_ROWS)
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def discard(df: DataFrame) -> None:
    """Delete the files behind a DataFrame that materialize returned, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives its memory back to the system when a task ends: Python workers are kept for later
    tasks, and what they hold counts against the executor."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return held


def text_or_empty(name: str = "text"):
    """The column as a string, null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


def row_key(id_col: str, text_col: str) -> tuple[Column, Column]:
    """Two hashes that tell rows apart by id and text wherever they are read; rows that repeat both share them."""
    number, text = F.col(id_col).cast("long"), text_or_empty(text_col)
    return F.xxhash64(text, number), F.xxhash64(F.lit(1), number, text)


def _word(key: Column) -> Column:
    return F.pmod(key, F.lit(SIEVE_WORDS)).cast("int")


def _mask(key: Column) -> Column:
    mask = None
    for shift in (40, 46, 52):
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(key, shift).bitwiseAND(F.lit(63).cast("long")).cast("int"))
        mask = bit if mask is None else mask.bitwiseOR(bit)
    return mask


def sieve(keys: DataFrame, key: str) -> DataFrame:
    """A Bloom filter of a long column, as (word, bits): SIEVE_WORDS rows at most, whatever keys holds."""
    return keys.groupBy(_word(F.col(key)).alias("word")).agg(F.bit_or(_mask(F.col(key))).alias("bits"))


def sieved(df: DataFrame, key: str, keys: DataFrame, key_of_keys: str) -> tuple[DataFrame, Column]:
    """df beside its word of the sieve of keys, and the condition that a row may be among them (never false for one that is)."""
    word, bits = fresh_name(df, "word"), fresh_name(df, "bits")
    found = F.broadcast(sieve(keys, key_of_keys).toDF(word, bits))
    joined = df.join(found, _word(F.col(key)) == F.col(word), "left")
    mask = _mask(F.col(key))
    return joined, F.coalesce(F.col(bits).bitwiseAND(mask) == mask, F.lit(False))


def texts_of(df: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """wanted (k1, k2 and more) with the column text of the row that has this key; only texts that pass the sieve are shuffled."""
    one, two = row_key(id_col, text_col)
    joined, maybe = sieved(df.select(one.alias("k1"), two.alias("k2"), text_or_empty(text_col).alias("text")), "k1", wanted, "k1")
    once = joined.where(maybe).groupBy("k1", "k2").agg(F.first("text").alias("text"))
    return once.join(wanted.hint("merge"), ["k1", "k2"])


def without(df: DataFrame, marked: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """df without the rows whose key (k1, k2) is in marked with gone = true; of those with gone = false, which repeat, one stays.

    Rows that the sieve of marked lets through, with few others, are shuffled; all others stay where they are. The plan is
    the same at every size: a sieve that fills up only lets more rows through to the join, which decides."""
    one, two = (fresh_name(df, n) for n in ("k1", "k2"))
    columns = [F.col(f"`{c}`") for c in df.columns]
    first, second = row_key(id_col, text_col)
    joined, maybe = sieved(df.withColumns({one: first, two: second}), one, marked, "k1")
    once = joined.where(maybe).groupBy(one, two).agg(F.first(F.struct(*columns)).alias("_row"))
    held = once.join(marked.select(F.col("k1").alias(one), F.col("k2").alias(two), "gone").hint("merge"), [one, two], "left")
    rest = held.where(~F.coalesce("gone", F.lit(False))).select(*[F.col("_row").getField(c).alias(c) for c in df.columns])
    return joined.where(~maybe).select(*columns).unionByName(rest)


def heavy_keys(groups: DataFrame, size: str, total: int) -> Column:
    """True for groups that hold more than one in HEAVY_KEYS of all rows; there are fewer of them than that."""
    return F.col(size) * HEAVY_KEYS > F.lit(total)


def join_groups(rows: DataFrame, groups: DataFrame, on: str, size: str, total: int) -> DataFrame:
    """rows joined to groups, which has one row per value of on and the number of its rows in size.

    Heavy groups are fewer than HEAVY_KEYS and broadcast; a light one is at most 1/HEAVY_KEYS of all rows, so no task of
    the shuffle gets more than that for one key."""
    big = heavy_keys(groups, size, total)
    heavy = F.broadcast(groups.where(big))
    light = rows.join(F.broadcast(groups.where(big).select(on)), on, "left_anti").join(groups.where(~big).hint("merge"), on)
    return rows.join(heavy, on).unionByName(light)
