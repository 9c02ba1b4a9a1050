"""SimHash near-dedup by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. If two fingerprints
differ in at most two bits, at least one segment differs by at most one, so it
is enough to look segments up as they are and with one bit deleted: an equality
join on the signature finds every pair, and the whole fingerprints verify it.

Which signature finds a pair is fixed, so each link comes out once:

* segment A equal: the signature is A as it is;
* A differs in one bit: the signature is A without that bit. One side has a 0
  there, the other a 1, so zeros are joined to ones and equal segments don't meet;
* A differs in two bits: B is equal, the signature is B as it is.

The rest of the distance budget is cut once more into pieces of the other
segment, one of which must be equal, so that a signature shared by very many
fingerprints is divided further instead of comparing all of its pairs.

Only distinct fingerprints are linked. Copies share one and are joined back.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm._store import discard, join_groups, materialize, row_key, text_or_empty, without

SEED = 42
SHINGLE_WORDS = 3
MAX_DISTANCE = 2
_HASH_BLOCK = 1 << 16
#: Edges whose stars are broadcast: two longs for either end of each, a few hundred kilobytes.
BROADCAST_EDGES = 10_000


def majority(blocks: Iterable[np.ndarray], n: int) -> int:
    """The unsigned 64-bit SimHash of n hashes, given in blocks: a bit is 1 if set in over half of them; 0 without any."""
    ones = np.zeros(64, np.int64)
    for hashes in blocks:
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes) -> int:
    """The SimHash of a UTF-8 text's shingles, repeats included; 0 without words."""
    words = text.lower().split()  # on bytes both touch ASCII only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE_WORDS:
        return digest(b" ".join(words), SEED)
    n = len(words) - SHINGLE_WORDS + 1
    blocks = (words[at : at + _HASH_BLOCK + SHINGLE_WORDS - 1] for at in range(0, n, _HASH_BLOCK))
    return majority((np.fromiter((digest(b"%b %b %b" % s, SEED) for s in zip(w, w[1:], w[2:])), np.uint64, len(w) - SHINGLE_WORDS + 1) for w in blocks), n)


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [fingerprint(t) for t in b["text"].cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([b["id"], b["k1"], b["k2"], pa.array(np.array(found, np.uint64).view(np.int64))], names=_SCHEMA.names)


def _segment(number: int) -> Column:
    """Segment A (0) or B (1) of the column print, as a non-negative long."""
    return F.shiftrightunsigned("print", 32 * number).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def _pieces(value: Column, widths: list[int]) -> Column:
    """(number, piece) of a segment cut into pieces of the given widths, as one long each."""
    out, at = [], 0
    for i, w in enumerate(widths):
        out.append(F.shiftright(value, at).bitwiseAND(F.lit((1 << w) - 1).cast("long")) + F.lit(i * (1 << 32)).cast("long"))
        at += w
    return F.array(*out)


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(prints: DataFrame) -> DataFrame:
    """All pairs (a, b), a < b, of a table of distinct longs 'print' that differ in at most two bits; each pair once or a few times.

    Spark sizes a table behind an explode as one row per row, so every join says that it is a merge: else it broadcasts
    signatures, 32 times as large as it takes them to be."""
    a, b = _segment(0), _segment(1)
    first = lambda n: F.shiftrightunsigned(F.col("p").bitwiseXOR(F.col("q")), 32 * n).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))

    def equal(segment: Column, other: Column) -> DataFrame:
        # two bits at most in the other segment: of three pieces one is equal
        keyed = prints.select("print", segment.alias("segment"), F.explode(_pieces(other, [11, 11, 10])).alias("piece"))
        return keyed.select(F.col("print").alias("p"), "segment", "piece").join(keyed.select(F.col("print").alias("q"), "segment", "piece").hint("merge"), ["segment", "piece"])

    # one bit at most in B: of two pieces one is equal
    cut = prints.select("print", a.alias("segment"), F.explode(_pieces(b, [16, 16])).alias("piece"))
    bits = F.explode(F.sequence(F.lit(0), F.lit(31)))
    wild = cut.select("print", "segment", "piece", bits.alias("bit"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    signed = wild.withColumn("set", F.col("segment").bitwiseAND(one) != 0).withColumn(
        "key", F.xxhash64(F.col("segment").bitwiseAND(F.bitwise_not(one)), "bit", "piece")
    )
    zeros = signed.where(~F.col("set")).select(F.col("print").alias("p"), "key")
    ones = signed.where("set").select(F.col("print").alias("q"), "key")
    near = _distance("p", "q") <= MAX_DISTANCE
    same_a = equal(a, b).where((F.col("p") < F.col("q")) & near).select("p", "q")
    same_b = equal(b, a).where((F.col("p") < F.col("q")) & near & (first(0) != 0)).select("p", "q")
    off_by_one = zeros.join(ones.hint("merge"), "key").where(near & (F.bit_count(first(0)) == 1))
    off_by_one = off_by_one.select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"))
    return same_a.unionByName(same_b).unionByName(off_by_one).select(F.col("p").alias("a"), F.col("q").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an edge table (a, b) of longs; root is the smallest node reachable.

    Alternating large and small stars: each round is two joins on edges, written to the shared folder, and the rounds
    grow with the logarithm of the longest chain; it ends when a round changes nothing. Self-loops are fine; an empty
    table gives an empty one."""

    def bounded(low: DataFrame) -> DataFrame:  # Parquet files of roots are far smaller than their rows, so Spark's own guess isn't asked
        return F.broadcast(low) if count <= BROADCAST_EDGES else low.hint("merge")

    def large(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        return both.join(bounded(low), "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        rest = down.join(bounded(low), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return rest.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()

    now, state = materialize(edges.where("a <> b").select("a", "b").distinct(), "edges"), None
    count = now.count()
    while count:
        before, now = now, materialize(small(large(now)), "edges", count)
        discard(before)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state, count = seen, seen[0]
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


_SCHEMA = T.StructType([T.StructField(n, T.LongType()) for n in ("id", "k1", "k2", "print")])


def _grouped(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, k1, k2, print, component (smallest id of the component) and stays (the key of its first row) of every row of df."""
    one, two = row_key(id_col, text_col)
    rows = df.select(F.col(id_col).cast("long").alias("id"), one.alias("k1"), two.alias("k2"), text_or_empty(text_col).alias("text"))
    prints = materialize(rows.mapInArrow(_prints, _SCHEMA), "prints")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "k1", "k2")
    distinct = materialize(prints.groupBy("print").agg(F.min(place).alias("best"), F.count("*").alias("times")), "distinct-prints")
    roots = components(links(distinct.select("print")))
    member = distinct.join(roots.hint("merge"), distinct["print"] == roots["node"], "left").select("print", "times", "best", F.coalesce("root", "print").alias("root"))
    member = materialize(member, "members")
    least = materialize(member.groupBy("root").agg(F.min("best").alias("stays"), F.count("*").alias("n")), "roots")
    found = join_groups(member.drop("best"), least, "root", "n", member.count()).select("print", "times", "stays")
    return join_groups(prints, materialize(found, "components"), "print", "times", prints.count())


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: the id, fingerprint (16 hex digits), component_id.

    Words are runs of anything but [\\x20\\x09-\\x0D], A-Z lower-cased; shingles of three words, repeats included, or the
    whole sequence if it is shorter. A null or wordless text has fingerprint zero, which links like any other.
    component_id is the smallest id reachable over links, the row's own included; it is null where all of a component's
    ids are. Repeated rows come out as often as they are in df; an empty table gives an empty one."""
    return _grouped(df, id_col, text_col).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.col("stays.id").alias("component_id"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with df's columns: the one with the smallest id, null ids counting as largest; a hash
    decides between texts of one id, and of rows that repeat both one stays, whichever.

    Rows are told apart by id and text, so df may be computed anew in any order."""
    rows = _grouped(df, id_col, text_col)
    goes = (F.col("k1") != F.col("stays.k1")) | (F.col("k2") != F.col("stays.k2"))
    marked = rows.groupBy("k1", "k2").agg(F.first(goes).alias("gone"), F.count("*").alias("n")).where("gone OR n > 1")
    return without(df, materialize(marked.select("k1", "k2", "gone"), "marked"), id_col, text_col)
