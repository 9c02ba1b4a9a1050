"""Homomorphic multiset fingerprints of documents.

A text is the multiset of its paragraphs (lines). Every paragraph is hashed to
a wide vector, and the fingerprint is the sum of these vectors, lane by lane,
modulo a power of two. So it does not depend on the paragraphs' order, and a
paragraph is put in or taken out by adding or subtracting its vector.

The vector has two parts:

* EQUAL_LANES lanes of 32 bits from the paragraph's SHA-256: they tell
  multisets apart;
* NEAR_LANES lanes of 16 bits, each the sum over the paragraph's pieces (a few
  words of a sentence) of +1 or -1, by a bit of the piece's hash: the scalar
  product of two such sums estimates how many pieces they share, so they tell
  how alike two texts are. Its standard error is about 1/sqrt(NEAR_LANES).

Everything is a DataFrame operation. Texts are dealt out once, by ranges of
ids; the sums then need no exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm._store import text_or_empty

EQUAL_LANES = 8
NEAR_LANES = 128
#: A piece: up to 24 characters of a sentence and on to the end of the word, with what ends the sentence.
PIECE = r"[^.!?。]{1,24}[^.!?。\s]{0,200}[.!?。\s]*|[.!?。]+\s*"
#: Rows of one range of ids, on average, and the most ranges there are; ranges are what one task sorts.
ROWS_PER_RANGE = 500
MAX_RANGES = 20_000

_MASK = 0x0000000100000001


def _paragraphs(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _sums(exploded: DataFrame, keys: list[str]) -> DataFrame:
    """eq (array of EQUAL_LANES longs below 2^32) and near (array of NEAR_LANES signed longs) per keys of a table with text."""
    paragraph = exploded.withColumn("_p", F.explode(_paragraphs(F.col("text")))).drop("text")
    digest = F.sha2(F.col("_p").cast("binary"), 256)
    lanes = {f"_e{i}": F.conv(F.substring("_digest", 8 * i + 1, 8), 16, 10).cast("long") for i in range(EQUAL_LANES)}
    hashed = paragraph.withColumn("_digest", digest).withColumns(lanes).drop("_digest")
    pieces = hashed.select(*keys, *lanes, F.posexplode_outer(F.regexp_extract_all("_p", F.lit(PIECE), F.lit(0))).alias("_at", "_piece"))
    first = F.coalesce(F.col("_at"), F.lit(0)) == 0
    has = F.col("_piece").isNotNull()
    named = pieces.select(*keys, *[F.when(first, F.col(e)).otherwise(0).alias(e) for e in lanes], F.when(has, 1).otherwise(0).alias("_one"),
                          F.when(has, F.xxhash64("_piece")).otherwise(0).alias("_h0"), F.when(has, F.xxhash64("_piece", F.lit(1))).otherwise(0).alias("_h1"))
    mask = F.lit(_MASK).cast("long")
    packed = [F.sum(F.shiftrightunsigned(f"_h{h}", j).bitwiseAND(mask)).alias(f"_n{h}_{j}") for h in (0, 1) for j in range(32)]
    summed = named.groupBy(*keys).agg(*[F.sum(e).alias(e) for e in lanes], F.sum("_one").alias("_total"), *packed)
    two32 = F.lit(1 << 32).cast("long")
    eq = F.array(*[F.pmod(F.col(e), two32) for e in lanes])
    low = F.lit(0xFFFFFFFF).cast("long")
    ones = [x for h in (0, 1) for j in range(32) for x in (F.col(f"_n{h}_{j}").bitwiseAND(low), F.shiftrightunsigned(f"_n{h}_{j}", 32))]
    near = F.transform(F.array(*ones), lambda n: 2 * n - F.col("_total"))
    return summed.select(*keys, eq.alias("eq"), near.alias("near"))


def _hex(eq: Column, near: Column) -> Column:
    """Both parts as lowercase hex: 8 digits a lane of the first, 4 a lane (modulo 2^16) of the second."""
    a = F.array_join(F.transform(eq, lambda x: F.lpad(F.hex(x), 8, "0")), "")
    b = F.array_join(F.transform(near, lambda x: F.lpad(F.hex(F.pmod(x, F.lit(65536))), 4, "0")), "")
    return F.lower(F.concat(a, b))


def likeness(a: Column, b: Column, same: Column) -> Column:
    """0 to 1 for two signed lane arrays: 2ab / (aa + bb), cut off at 0; 1 where same holds."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: (p * q).cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = dot(a, a) + dot(b, b)
    return F.when(same, F.lit(1.0)).when(size == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * dot(a, b) / size)))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per id: the id, eq, near and fingerprint (hex). Null texts count as empty.

    Rows that repeat an id are summed, as their texts' union: use distinct ids for a fingerprint per row."""
    rows = df.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("text"))
    return _sums(rows, ["_id"]).select(F.col("_id").alias(id_col), "eq", "near", _hex(F.col("eq"), F.col("near")).alias("fingerprint"))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Lanes of two eq arrays added (sign 1: insertion) or subtracted (-1: deletion), modulo 2^32."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + sign * y, F.lit(1 << 32).cast("long")))


def _ranges(ids: DataFrame, rows: int) -> list[int]:
    """Ids that cut a column id into even ranges: at most MAX_RANGES of them come to the driver."""
    n = max(1, min(MAX_RANGES, -(-rows // ROWS_PER_RANGE)))
    if n == 1:
        return []
    cuts = ids.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 10 * n).alias("c")).first()[0]
    return sorted(set(cuts or []))


def _range_of(column: Column, cuts: list[int]) -> Column:
    """The number of cuts at or below the id: a first search picks a block of 64 cuts, a second one the cut. Null ids are in range 0."""
    if not cuts:
        return F.lit(0)
    held = F.from_json(F.lit(str(cuts)), "array<bigint>")
    heads = F.from_json(F.lit(str(cuts[64::64])), "array<bigint>")
    block = F.size(F.filter(heads, lambda c: c <= column))
    return F.coalesce(block * 64 + F.size(F.filter(F.slice(held, block * 64 + 1, 64), lambda c: c <= column)), F.lit(0))


def edited_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: range, rank, id, text, edited, n_chars; rank orders a range.

    edited: the last floor(n_chars/4) code points give way to the first as many of the next row by id (the first row
    follows the last one; a single row follows itself). Rows of one id are ordered by their text; null ids come first."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    total = rows.count()
    cuts = _ranges(rows.where("id is not null"), total)
    return _with_next(rows.withColumn("range", _range_of(F.col("id"), cuts)))


def _with_next(ranged: DataFrame) -> DataFrame:
    # A range's last row needs the first row of the next range that has rows: one row per range, brought in beforehand.
    order = [F.col("id").asc_nulls_first(), F.col("text")]
    firsts = ranged.groupBy("range").agg(F.min(F.when(F.col("id").isNotNull(), F.col("id"))).alias("low"), F.max(F.col("id").isNull()).alias("bare"))
    around = Window.orderBy("range")  # one row per range: at most MAX_RANGES
    marks = firsts.select("range", "low", "bare", F.lag("range").over(around).alias("before"), F.max("range").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("last"))
    marks = marks.select("range", F.when(F.col("bare"), F.lit(None)).otherwise(F.col("low")).alias("low"), F.coalesce("before", "last").alias("goes_to"))
    heads = (
        ranged.join(F.broadcast(marks), (ranged["range"] == marks["range"]) & ranged["id"].eqNullSafe(marks["low"]))
        .groupBy(marks["goes_to"], ranged["id"])
        .agg(F.min(ranged["text"]).alias("text"))
        .select("id", "text", F.col("goes_to").alias("range"), F.lit(1).alias("guest"))
    )
    both = ranged.select("id", "text", "range", F.lit(0).alias("guest")).unionByName(heads)
    inside = Window.partitionBy("range").orderBy("guest", *order)
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    following = F.coalesce(F.lead("text").over(inside), F.col("text"))
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("_next", F.lit(1), cut))
    return (
        both.withColumns({"rank": F.row_number().over(inside), "_next": following})
        .select("range", "rank", "guest", "id", "text", n.cast("long").alias("n_chars"), F.when(F.col("guest") == 0, edited).alias("edited"))
    )


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: the id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    near_edited is the likeness of the text's and the edited text's fingerprints, near_next of the text's and the next
    row's. A null text counts as empty; equal multisets of paragraphs have equal fingerprints and likeness 1. Repeated
    rows come out each; an empty table gives an empty one; other columns of df are left out."""
    pairs = edited_pairs(df, id_col, text_col)
    keys = ["range", "rank", "guest", "id", "n_chars", "edited_sha256", "kind"]
    texts = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))
    both = (
        pairs.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
        .withColumn("_both", F.explode(F.filter(texts, lambda t: t["text"].isNotNull())))
        .select("range", "rank", "guest", "id", "n_chars", "edited_sha256", F.col("_both.kind").alias("kind"), F.col("_both.text").alias("text"))
    )
    sums = _sums(both, keys).select(*keys, F.struct("eq", "near").alias("print"))
    row = sums.groupBy("range", "rank").agg(
        F.first("guest").alias("guest"), F.first("id").alias("id"), F.first("n_chars").alias("n_chars"), F.first("edited_sha256").alias("edited_sha256"),
        F.max(F.when(F.col("kind") == 0, F.col("print"))).alias("own"), F.max(F.when(F.col("kind") == 1, F.col("print"))).alias("edit"),
    )
    inside = Window.partitionBy("range").orderBy("rank")
    row = row.withColumn("next", F.coalesce(F.lead("own").over(inside), F.col("own"))).where("guest = 0")
    return row.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256",
        _hex(F.col("own.eq"), F.col("own.near")).alias("fingerprint"),
        _hex(F.col("edit.eq"), F.col("edit.near")).alias("edited_fingerprint"),
        likeness(F.col("own.near"), F.col("edit.near"), F.col("own") == F.col("edit")).alias("near_edited"),
        likeness(F.col("own.near"), F.col("next.near"), F.col("own") == F.col("next")).alias("near_next"),
    )
