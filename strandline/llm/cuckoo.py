"""Exact dedup through a cuckoo-filter index of live digests.

The index holds a 16-bit fingerprint of every live digest in one of two
buckets of four slots; a probe that hits is verified against the stored
digests of the bucket's content, so the filter only saves look-ups and never
decides. Deleting removes the stored digest and its fingerprint. An insertion
that finds no free slot doubles the filter and refills it from the stored
digests.

Spark deals partial results out by digest: every input task folds its own
repeats first, through an index as well, so a text that makes up a third of all
rows arrives as one row per task, and every index bucket is merged on its own,
in bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm._store import join_groups, materialize, released, row_key, text_or_empty, without

#: Digests in one index bucket, on average; an index takes about 250 bytes a digest.
DIGESTS_PER_BUCKET = 100_000
#: Digests that an input task holds before it passes them on.
FOLD_LIMIT = 200_000
SLOTS = 4
MAX_KICKS = 200


class CuckooIndex:
    """Live digests (16 bytes or more each) with a record per digest."""

    def __init__(self, buckets: int = 1024):
        self._size = 1 << max(1, (buckets - 1).bit_length())
        self._table: list[list[int]] = [[] for _ in range(self._size)]
        self._stored: dict[int, dict[bytes, object]] = {}
        self._live = 0
        self.resizes = 0

    def __len__(self) -> int:
        return self._live

    @staticmethod
    def _print(digest: bytes) -> int:
        return int.from_bytes(digest[8:10], "big") or 1

    def _home(self, digest: bytes) -> int:
        return int.from_bytes(digest[:8], "big") & (self._size - 1)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * 0x5BD1E995 & (self._size - 1))

    def maybe(self, digest: bytes) -> bool:
        """What the filter alone says: no false negatives."""
        mark, home = self._print(digest), self._home(digest)
        return mark in self._table[home] or mark in self._table[self._other(home, mark)]

    def get(self, digest: bytes):
        """The live digest's record, or None; a filter hit is verified against the stored digests."""
        if not self.maybe(digest):
            return None
        return self._stored.get(int.from_bytes(digest[:8], "big") >> 40, {}).get(digest)

    def insert(self, digest: bytes, record: object) -> None:
        """Add a digest that is not live, or replace the record of one that is."""
        content = self._stored.setdefault(int.from_bytes(digest[:8], "big") >> 40, {})
        new = digest not in content
        content[digest] = record
        if new:
            self._live += 1
            if not self._place(digest):
                self._grow()

    def delete(self, digest: bytes) -> bool:
        """Take a live digest out; False if it was not live."""
        content = self._stored.get(int.from_bytes(digest[:8], "big") >> 40, {})
        if content.pop(digest, None) is None:
            return False
        self._live -= 1
        mark, home = self._print(digest), self._home(digest)
        for bucket in (home, self._other(home, mark)):
            if mark in self._table[bucket]:
                self._table[bucket].remove(mark)
                break
        return True

    def items(self) -> Iterator[tuple[bytes, object]]:
        for content in self._stored.values():
            yield from content.items()

    def _place(self, digest: bytes) -> bool:
        mark, bucket = self._print(digest), self._home(digest)
        for b in (bucket, self._other(bucket, mark)):
            if len(self._table[b]) < SLOTS:
                self._table[b].append(mark)
                return True
        for kick in range(MAX_KICKS):
            row = self._table[bucket]
            row[kick % SLOTS], mark = mark, row[kick % SLOTS]
            bucket = self._other(bucket, mark)
            if len(self._table[bucket]) < SLOTS:
                self._table[bucket].append(mark)
                return True
        return False

    def _grow(self) -> None:
        """Double until every stored digest fits; a run of equal fingerprints and homes ends as digests differ in later bits."""
        while True:
            self._size *= 2
            self.resizes += 1
            self._table = [[] for _ in range(self._size)]
            if all(self._place(d) for d, _ in self.items()):
                return


def normalized(text: Column) -> Column:
    """The text with every run of [\\x20\\x09-\\x0D] as one space."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


_FOLDED = "bucket int, digest binary, no_id boolean, first_id long, first_row long, n long"
_ARROW = pa.schema([("bucket", pa.int32()), ("digest", pa.binary()), ("no_id", pa.bool_()), ("first_id", pa.int64()), ("first_row", pa.int64()), ("n", pa.int64())])


def _emit(index: CuckooIndex, bucket_of, into: pa.Schema) -> Iterator[pa.RecordBatch]:
    chunk: list[tuple] = []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*chunk), into)], schema=into)

    for digest, ((no_id, first_id, first_row), n) in index.items():
        chunk.append((bucket_of(digest), digest, no_id, first_id, first_row, n))
        if len(chunk) == 20_000:
            yield batch()
            chunk = []
    if chunk:
        yield batch()


def _fold_into(index: CuckooIndex, digest: bytes, place: tuple, n: int) -> None:
    if (held := index.get(digest)) is None:
        index.insert(digest, (place, n))
    else:
        index.insert(digest, (min(held[0], place), held[1] + n))


def _fold(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()
        bucket_of = lambda d: int.from_bytes(d[10:14], "big") % n_buckets
        for b in batches:
            for digest, first_id, row in zip(b["digest"].to_pylist(), b["id"].to_pylist(), b["row"].to_pylist()):
                _fold_into(index, digest, (first_id is None, first_id or 0, row), 1)
            if len(index) >= FOLD_LIMIT:
                yield from _emit(index, bucket_of, _ARROW)
                index = CuckooIndex()
        yield from _emit(index, bucket_of, _ARROW)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket, so that one index lives at a time."""
    index, now = CuckooIndex(), None
    for b in batches:
        for bucket, digest, no_id, first_id, row, n in zip(*(b[k].to_pylist() for k in _ARROW.names)):
            if bucket != now:
                yield from _emit(index, lambda _, k=now: k, _ARROW)
                index, now = CuckooIndex(), bucket
            _fold_into(index, digest, (no_id, first_id, row), n)
    yield from _emit(index, lambda _: now, _ARROW)


def _groups(rows: DataFrame, total: int) -> DataFrame:
    """digest, no_id, first_id, first_row, n of every group of equal digests."""
    n_buckets = max(1, -(-total // DIGESTS_PER_BUCKET))
    folded = rows.mapInArrow(released(_fold(n_buckets)), _FOLDED)
    spread = max(n_buckets, 1)
    return folded.repartition(spread, "bucket").sortWithinPartitions("bucket").mapInArrow(released(_merge), _FOLDED).drop("bucket")


def _digested(df: DataFrame, id_col: str, text_col: str, **more: Column) -> DataFrame:
    digest = F.unhex(F.sha2(normalized(text_or_empty(text_col)).cast("binary"), 256))
    return df.select(F.col(id_col).cast("long").alias("id"), digest.alias("digest"), *[c.alias(n) for n, c in more.items()])


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: the id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after every run of white space [\\x20\\x09-\\x0D] became one space; null is the empty
    text. The smallest id stays; among repeated rows of that id the first one in the input does, and null ids count as
    largest. An empty table gives an empty one; other columns of df are left out."""
    rows = materialize(_digested(df, id_col, text_col, row=F.monotonically_increasing_id()), "digests")
    total = rows.count()
    return join_groups(rows, materialize(_groups(rows, total), "groups"), "digest", "n", total).select(
        F.col("id").alias(id_col),
        F.when(~F.col("no_id"), F.col("first_id")).alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("first_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every group of equal texts, with df's columns: of the smallest id, null ids counting as largest.

    Of rows that repeat an id and a text one stays, whichever; where rows of one id have texts that differ in white space
    only, a hash decides. Rows are told apart by id and text, so df may be computed anew in any order. Null is the empty
    text; an empty table gives an empty one."""
    one, two = row_key(id_col, text_col)
    rows = materialize(_digested(df, id_col, text_col, row=one, k2=two), "digests")
    total = rows.count()
    groups = materialize(_groups(rows, total).where("n > 1"), "groups")
    held = join_groups(rows, groups, "digest", "n", total)
    stays = (F.col("row") == F.col("first_row")) & F.col("id").eqNullSafe(F.when(~F.col("no_id"), F.col("first_id")))
    marked = held.groupBy(F.col("row").alias("k1"), "k2").agg((~F.first(stays)).alias("gone"), F.count("*").alias("times")).where("gone OR times > 1")
    return without(df, materialize(marked.select("k1", "k2", "gone"), "marked"), id_col, text_col)


def apply_changes(live: DataFrame, changes: DataFrame) -> DataFrame:
    """Live digests after changes: both have a column digest (binary, 16 bytes at least); changes has inserted boolean.

    Each bucket's index takes the live digests, then the insertions, then the deletions; inserting a live digest and
    deleting one that is not live change nothing. Null digests are left out."""
    ops = live.select("digest", F.lit(0).alias("op")).unionByName(changes.select("digest", F.when(F.col("inserted"), 1).otherwise(2).alias("op"))).where("digest is not null")
    n_buckets = max(1, -(-ops.count() // DIGESTS_PER_BUCKET))
    spread = ops.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(n_buckets)).cast("int")).repartition(n_buckets, "bucket").sortWithinPartitions("bucket", "op")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, now, out = CuckooIndex(), None, pa.schema([("digest", pa.binary())])
        flush = lambda: pa.RecordBatch.from_arrays([pa.array([d for d, _ in index.items()], pa.binary())], schema=out)
        for b in batches:
            for bucket, digest, op in zip(b["bucket"].to_pylist(), b["digest"].to_pylist(), b["op"].to_pylist()):
                if bucket != now:
                    yield flush()
                    index, now = CuckooIndex(), bucket
                if op == 2:
                    index.delete(digest)
                elif index.get(digest) is None:
                    index.insert(digest, True)
        yield flush()

    return spread.mapInArrow(released(run), "digest binary")
