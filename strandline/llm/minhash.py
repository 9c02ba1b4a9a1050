"""Near-dedup by shingle similarity: SimHash signatures and MinHash bands find candidates, whole texts verify them.

The sets of shingles have SimHashes, which are linked at two or fewer differing bits by deletion-variant signatures (simhash.py);
each set of a component is compared to the least one. That finds the nearest copies. At a similarity of 0.8 two 64-bit
SimHashes differ in about ten bits, and segments short enough to stay equal then are shared by everything; bands of minima
find such pairs by equality. A pair of similarity s shares at least one of
24 bands of five minima with probability 1 - (1 - s^5)^24: 0.9999 at 0.8, more above.

What counts is which texts hang together. In each band's bucket all texts are first compared to the least one; texts
that aren't in the component most of the bucket is in are then compared to everything in it. All pairs left out
lie within one component already, so a bucket full of near copies takes as many comparisons as it has texts.

Where more than FEW texts of a bucket are outside that component, they are compared to further texts in it. Where that
leaves more than FEW outside (form letters that differ by a little too much, say), comparing would grow with the square of the bucket. Such texts are filtered by prefixes instead, which loses nothing: of
two sets with a similarity of s, the first n - ceil(s n) + 1 shingles of each, rarest first, have one in common, and from
the first common one on either has enough shingles left for that similarity. What form letters share is frequent among
them, so it comes behind what they don't share.

Only distinct shingle sets are linked. Texts with the same set share one and are joined back. Of the texts themselves only
those of candidates are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm._store import HEAVY_KEYS, discard, join_groups, materialize, released, row_key, sieved, text_or_empty, texts_of, without
from strandline.llm import simhash
from strandline.llm.simhash import SEED, components, majority

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
#: Texts of a bucket outside its largest component that are compared to all of it.
FEW = 16
#: Where more are outside, they are first compared to so many sets of the component, drawn anew as many times as HUB_ROUNDS says: in a crowd of
#: texts about as similar as asked for, nearly all get into the component by one of these.
HUBS, HUB_ROUNDS = 8, 1
#: Sets or texts that a task has in Python at a time.
_SLICE = 256
#: Counters of the table that tells rare shingles from frequent ones; it only rules the order, so clashes cost time alone.
COUNTERS = 1 << 19
_BLOCK = 1 << 9
_random = np.random.Generator(np.random.PCG64(SEED))
_FACTORS = _random.integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
_ADDENDS = _random.integers(0, 1 << 32, BANDS * ROWS, np.uint32)
_PLACE = np.uint64(0x9E3779B97F4A7C15)
_MIXERS = _random.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted distinct hashes of a UTF-8 text's shingles; of the whole word sequence if it is shorter; empty without words."""
    w = text.lower().split()  # on bytes both touch ASCII only
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED)], np.uint64)
    n, each = len(w) - words + 1, np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    mixed = np.zeros(n, np.uint64)
    for i in range(words):  # a word's hash counts by its place
        mixed = (mixed + each[i : i + n]) * _PLACE
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def bands(found: np.ndarray) -> np.ndarray:
    """One signed 64-bit key for each band of a set of shingles."""
    least, high = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32), (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(high), _BLOCK):
        least = np.minimum(least, (high[at : at + _BLOCK, None] * _FACTORS + _ADDENDS).min(axis=0))
    return (least.reshape(BANDS, ROWS) * _MIXERS).sum(axis=1, dtype=np.uint64).view(np.int64)


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, _SLICE):
            yield whole.slice(at, _SLICE)


def _sets(df: DataFrame, words: int) -> DataFrame:
    """id, k1, k2, print (a hash of the set of shingles), n (its size), simhash and bands of every row of (id, k1, k2, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches):
            prints, sizes, near, keys = [], [], [], []
            for t in b["text"]:
                found = shingles(t.as_py().encode(), words)
                prints.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
                sizes.append(len(found))
                near.append(majority((found[at : at + _BLOCK] for at in range(0, len(found), _BLOCK)), len(found)))
                keys.append(bands(found))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(keys) + 1, BANDS, np.int32)), pa.array(np.concatenate(keys)) if keys else pa.array([], pa.int64()))
            signed = [pa.array(np.array(v, np.uint64).view(np.int64)) for v in (prints, near)]
            yield pa.RecordBatch.from_arrays([b["id"], b["k1"], b["k2"], signed[0], pa.array(sizes, pa.int64()), signed[1], lists], names=["id", "k1", "k2", "print", "n", "simhash", "bands"])

    return df.mapInArrow(released(run), "id long, k1 long, k2 long, print long, n long, simhash long, bands array<long>")


def _with_set(pairs: DataFrame, sets: DataFrame, side: str, name: str, total: int) -> DataFrame:
    """pairs beside the shingles of one side. A side that very many pairs share is dealt out over several copies of its set,
    fewer than 2 * HEAVY_KEYS in all."""
    share = F.lit(max(total, 500 * HEAVY_KEYS))
    parts = F.ceil(F.col("times") * HEAVY_KEYS / share).cast("int")
    heavy = F.broadcast(pairs.groupBy(side).agg(F.count("*").alias("times")).where(F.col("times") * HEAVY_KEYS > share).select(side, parts.alias("parts")))
    whole = F.coalesce("parts", F.lit(1))
    other = "b" if side == "a" else "a"
    dealt = pairs.join(heavy, side, "left").withColumn("part", F.pmod(F.xxhash64(other), whole).cast("int")).drop("parts")
    copies = sets.select(F.col("print").alias(side), F.col("found").alias(name)).join(heavy, side, "left")
    copies = copies.select(side, name, F.explode(F.sequence(F.lit(0), whole - 1)).alias("part"))
    return dealt.join(copies.hint("merge"), [side, "part"]).drop("part")


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets in (print, found) are at least so similar."""
    total = pairs.count()
    both = F.size(F.array_intersect("t", "u"))
    held = _with_set(_with_set(pairs, sets, "b", "u", total), sets, "a", "t", total).withColumn("both", both)
    return held.where(F.col("both") / (F.size("t") + F.size("u") - F.col("both")) >= least).select("a", "b")


def _ends(pairs: DataFrame) -> DataFrame:
    """print: the sets in the pairs (a, b)."""
    return pairs.select(F.explode(F.array("a", "b")).alias("print")).distinct()


def _sets_of(df: DataFrame, nodes: DataFrame, distinct: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """print and found, the shingles, of every set in nodes (print)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches):  # sets take more room than their texts
            found = [shingles(t.as_py().encode(), words).view(np.int64) for t in b["text"]]
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b["print"], pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))], names=["print", "found"])

    wanted = distinct.join(nodes.hint("merge"), "print").select("print", F.col("best.k1").alias("k1"), F.col("best.k2").alias("k2"))
    texts = texts_of(df, materialize(wanted, "wanted"), id_col, text_col)
    return materialize(texts.select("print", "text").mapInArrow(released(run), "print long, found array<long>"), "candidate-sets")


def _sizes_allow(n: str, m: str, least: float):
    return F.least(n, m) >= F.greatest(n, m) * least - 1e-6  # a set can't be that similar to a much smaller one


def _within_bits(distinct: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of the least set of each component of SimHash links with every other set of it."""
    linked = components(simhash.links(materialize(distinct.select(F.col("simhash").alias("print")).distinct(), "distinct-prints")))
    rooted = distinct.select("print", "n", "simhash").join(linked.withColumnRenamed("node", "simhash").hint("merge"), "simhash", "left")
    rooted = materialize(rooted.select("print", "n", F.coalesce("root", "simhash").alias("root")), "simhash-roots")
    heads = materialize(rooted.groupBy("root").agg(F.count("*").alias("k"), F.min(F.struct("print", "n")).alias("low")).where("k > 1"), "simhash-heads")
    held = join_groups(rooted, heads, "root", "k", rooted.count()).where(F.col("print") != F.col("low.print")).where(_sizes_allow("n", "low.n", least))
    return held.select(F.col("low.print").alias("a"), F.col("print").alias("b"))


def _candidates(distinct: DataFrame) -> DataFrame:
    """key, print, n, low, k of every band that several sets share: low is the least of them, k their number."""
    keys = distinct.select("print", "n", F.explode("bands").alias("key"))
    heads = keys.groupBy("key").agg(F.count("*").alias("k"), F.min(F.struct("print", "n")).alias("low"))
    heads = materialize(heads.where("k > 1"), "heads")
    some, maybe = sieved(keys, "key", heads, "key")  # most bands are one set's own
    return materialize(join_groups(some.where(maybe).select("print", "n", "key"), heads, "key", "k", distinct.count() * BANDS), "keys")


def _slot(found: np.ndarray) -> np.ndarray:
    return (found.view(np.uint64) * _PLACE >> np.uint64(64 - (COUNTERS - 1).bit_length())).astype(np.int64)


def _counters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(COUNTERS, np.int64)
    for b in _few(batches):
        total += np.bincount(_slot(b["found"].flatten().to_numpy()), minlength=COUNTERS)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["slot", "n"])


def _prefixed(sets: DataFrame, least: float) -> DataFrame:
    """print, shingle, left: of every set (print, found) as many of its rarest shingles as a similar set can't do without, and
    how many the set has from there on."""
    counted = sets.select("found").mapInArrow(released(_counters), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    often = np.zeros(COUNTERS, np.int64)
    often[counted["slot"].to_numpy()] = counted["n"].to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches):
            whole, ends, kept = b["found"].flatten().to_numpy(), np.asarray(b["found"].value_lengths()).cumsum(), []
            for at, end in zip([0, *ends[:-1]], ends):
                found = whole[at:end]
                kept.append(found[np.lexsort((found, often[_slot(found)]))[: len(found) - int(np.ceil(least * len(found) - 1e-9)) + 1]])
            sizes = [len(k) for k in kept]
            left = np.concatenate([n - np.arange(k) for n, k in zip(b["found"].value_lengths().to_numpy(), sizes)]) if kept else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b["print"].to_numpy(), sizes)), pa.array(np.concatenate(kept) if kept else np.empty(0, np.int64)), pa.array(left.astype(np.int64))], names=["print", "shingle", "left"])

    return sets.select("print", "found").mapInArrow(released(run), "print long, shingle long, left long")


def _across(rooted: DataFrame, key: str, least: float, most: DataFrame, total: int) -> DataFrame:
    """Pairs (a, b) of sets of one key that lie in different components, one of them not in the key's largest; most has
    (key, top, all) of the keys with several. Where rooted has left (see _prefixed), both must have enough left."""
    mixed = materialize(join_groups(rooted, most, key, "all", total), "mixed")
    minor = mixed.where(F.col("root") != F.col("top")).select(key, F.col("print").alias("p"), F.col("n").alias("m"), F.col("root").alias("r"), *([F.col("left").alias("l")] if "left" in mixed.columns else []))
    fits = (F.col("root") != F.col("r")) & _sizes_allow("n", "m", least)
    if "left" in mixed.columns:
        fits = fits & (F.least("left", "l") >= (F.col("n") + F.col("m")) * (least / (1 + least)) - 1e-6)
    rest = mixed.join(minor.hint("merge"), key).where(fits)
    return rest.select(F.least("print", "p").alias("a"), F.greatest("print", "p").alias("b")).distinct()


def _to_hubs(rooted: DataFrame, most: DataFrame, total: int, turn: int, least: float) -> DataFrame:
    """Pairs (a, b) of the sets outside a key's largest component with HUBS sets of that component, others in every turn."""
    mixed = materialize(join_groups(rooted, most.drop("minor"), "key", "all", total), "mixed")
    own, others = mixed.where(F.col("root") == F.col("top")), mixed.where(F.col("root") != F.col("top"))
    drawn = F.array(*[F.min_by(F.struct("print", "n"), F.xxhash64("print", F.lit(turn * HUBS + i))) for i in range(HUBS)])
    hubs = own.groupBy("key").agg(F.array_distinct(drawn).alias("h")).select("key", F.explode("h").alias("h")).select("key", F.col("h.print").alias("p"), F.col("h.n").alias("m"))
    pairs = others.join(hubs.hint("merge"), "key").where(_sizes_allow("n", "m", least))
    return pairs.select(F.least("print", "p").alias("a"), F.greatest("print", "p").alias("b")).distinct()


def _mixed_keys(rooted: DataFrame, key: str) -> DataFrame:
    """Of each key with several components: top (the largest), all (its sets), minor (those outside the largest)."""
    most = rooted.groupBy(key, "root").agg(F.count("*").alias("k")).groupBy(key).agg(F.max(F.struct("k", "root")).alias("t"), F.count("*").alias("roots"), F.sum("k").alias("all"))
    return most.where("roots > 1").select(key, F.col("t.root").alias("top"), "all", (F.col("all") - F.col("t.k")).alias("minor"))


def similar_links(df: DataFrame, distinct: DataFrame, id_col: str, text_col: str, words: int, least: float) -> DataFrame:
    """Pairs (a, b) of prints of similar texts that hold the same components together as all such pairs do."""
    keys = _candidates(distinct)
    star = keys.where(F.col("print") != F.col("low.print")).where(_sizes_allow("n", "low.n", least))
    star = star.select(F.col("low.print").alias("a"), F.col("print").alias("b")).unionByName(_within_bits(distinct, least))
    star = materialize(star.distinct(), "star")
    sets = _sets_of(df, _ends(star), distinct, id_col, text_col, words)
    links = materialize(_verified(star, sets, least), "links")
    discard(sets)

    met = star
    for turn in range(HUB_ROUNDS + 1):
        rooted = keys.join(components(links).withColumnRenamed("node", "print").hint("merge"), "print", "left").withColumn("root", F.coalesce("root", "print"))
        rooted = materialize(rooted.select("key", "print", "n", "root"), "rooted")
        total, most = rooted.count(), materialize(_mixed_keys(rooted, "key"), "mixed-keys")
        if turn == HUB_ROUNDS or not most.where(F.col("minor") > FEW).take(1):
            break
        tried = materialize(_to_hubs(rooted, most.where(F.col("minor") > FEW), total, turn, least).join(met.hint("merge"), ["a", "b"], "left_anti"), "hub-pairs")
        sets = _sets_of(df, _ends(tried), distinct, id_col, text_col, words)
        links, met = materialize(links.unionByName(_verified(tried, sets, least)), "links"), materialize(met.unionByName(tried), "met")
        discard(sets)
    rest = materialize(_across(rooted, "key", least, most.where(F.col("minor") <= FEW).drop("minor"), total).join(met.hint("merge"), ["a", "b"], "left_anti"), "rest")
    large = most.where(F.col("minor") > FEW).select("key", "all")
    crowd = materialize(join_groups(rooted, large, "key", "all", total).select("print", "n", "root").distinct(), "crowd")
    sets = _sets_of(df, _ends(rest).union(crowd.select("print")).distinct(), distinct, id_col, text_col, words)
    if crowd.take(1):
        rare = _prefixed(sets.join(crowd.select("print").hint("merge"), "print", "left_semi"), least)
        rare = materialize(rare.join(crowd.hint("merge"), "print"), "rare-shingles")
        shared = materialize(_mixed_keys(rare, "shingle").drop("minor"), "shared-shingles")
        near = _across(rare, "shingle", least, shared, rare.count()).join(met.hint("merge"), ["a", "b"], "left_anti")
        rest = materialize(rest.union(near).distinct(), "rest")
    more = materialize(_verified(rest, sets, least), "links")
    discard(sets)
    return links.unionByName(more)


def drop_similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, least: float = SIMILARITY) -> DataFrame:
    """One row of each component of texts whose shingles' Jaccard similarity is at least so much, with df's columns: the one
    with the smallest id, null ids counting as largest; a hash decides between texts of one id, and of rows that repeat
    both one stays, whichever.

    Words are runs of anything but [\\x20\\x09-\\x0D], A-Z lower-cased; null is the empty text. Texts without words are
    similar to one another only. Rows are told apart by id and text, so df may be computed anew in any order. An empty
    table gives an empty one."""
    one, two = row_key(id_col, text_col)
    rows = df.select(F.col(id_col).cast("long").alias("id"), one.alias("k1"), two.alias("k2"), text_or_empty(text_col).alias("text"))
    sets = materialize(_sets(rows, words), "shingle-sets")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "k1", "k2")
    distinct = sets.groupBy("print").agg(F.first("n").alias("n"), F.first("simhash").alias("simhash"), F.first("bands").alias("bands"), F.min(place).alias("best"), F.count("*").alias("times"))
    distinct = materialize(distinct, "distinct-sets")
    links = similar_links(df, distinct, id_col, text_col, words, least)

    known = distinct.join(components(links).withColumnRenamed("node", "print").hint("merge"), "print", "left").where("root IS NOT NULL OR times > 1")
    known = materialize(known.select("print", "times", "best", F.coalesce("root", "print").alias("root")), "known")
    best = known.groupBy("root").agg(F.min("best").alias("stays"), F.count("*").alias("prints"))
    known = materialize(join_groups(known.drop("best"), materialize(best, "best"), "root", "prints", known.count()), "known")
    held = join_groups(sets.select("print", "k1", "k2"), known.select("print", "times", "stays"), "print", "times", sets.count())
    goes = (F.col("k1") != F.col("stays.k1")) | (F.col("k2") != F.col("stays.k2"))
    marked = held.groupBy("k1", "k2").agg(F.first(goes).alias("gone"), F.count("*").alias("copies")).where("gone OR copies > 1")
    return without(df, materialize(marked.select("k1", "k2", "gone"), "marked"), id_col, text_col)
