"""URL rules judged by Bloom filter cascades.

A cascade gives exact membership of every key in a known universe: level 1
encodes the listed keys, level 2 the universe's keys that level 1 wrongly lets
through, level 3 the listed keys that level 2 wrongly stops, and so on until a
level has no false positive. A key is listed if the first level that rejects
it is an even one (counted from 1), or, when no level rejects it, if the
cascade's depth is odd.

The universe is every (host suffix, path prefix) pair of the corpus that a
rule could name. It is scanned where it lies, never gathered: only keys that
pass level 1 come to the driver, and with the sizing used here they are about
1.7 times the listed keys, whatever the corpus holds. Lists of more than
BLOCK_KEYS keys get one cascade per block of keys, so a filter that is sent
with the plan never exceeds a fixed size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys in one cascade; a first level then takes at most about 2 MB of bits.
BLOCK_KEYS = 200_000
LEVEL_RATE = 0.5


@dataclass(frozen=True)
class Rule:
    """verdict is 'block' or 'allow'; host has no leading dot, path starts with '/' or is empty."""

    verdict: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


@dataclass
class Level:
    words: list[int]
    n_bits: int
    n_hashes: int


@dataclass
class Cascade:
    levels: list[Level] = field(default_factory=list)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL column; both empty where there is no '://' or the URL is null."""
    raw = F.coalesce(url.cast("string"), F.lit(""))
    at = F.locate("://", raw)
    rest = F.when(at > 0, F.substring(raw, at + 3, F.length(raw))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    after = F.substring(rest, F.length(host) + 1, F.length(rest))
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lowered, F.regexp_extract(after, r"^([^?#]*)", 1)


def candidate_keys(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The keys that a rule could have and still fit: suffixes of whole labels and path prefixes of the rules' own lengths.

    Longest key first, so the first listed one wins."""
    labels = sorted({r.host.count(".") + 1 for r in rules})
    lengths = sorted({len(r.path) for r in rules})
    pieces = F.split(host, r"\.", -1)
    keys = []
    for n in labels:
        suffix = F.when(F.size(pieces) >= n, F.array_join(F.slice(pieces, F.greatest(F.size(pieces) - n + 1, F.lit(1)), n), "."))
        for m in lengths:
            keys.append(F.when((host != "") & (F.length(path) >= m), F.concat(suffix, F.substring(path, 1, m) if m else F.lit(""))))
    found = F.filter(F.array(*keys), lambda k: k.isNotNull())
    return F.array_sort(found, lambda a, b: F.coalesce(F.nullif(F.length(b) - F.length(a), F.lit(0)), F.when(a < b, F.lit(-1)).when(a > b, F.lit(1)).otherwise(F.lit(0))))


def _slots(key: Column, level: Level, number: int) -> list[Column]:
    """The bit numbers of a key at a level; the level's number salts the hashes so that levels err independently."""
    return [F.pmod(F.xxhash64(key, F.lit(number), F.lit(i)), F.lit(level.n_bits)) for i in range(level.n_hashes)]


def _passes(key: Column, level: Level, number: int) -> Column:
    words = F.array(*[F.lit(w).cast("long") for w in level.words]) if len(level.words) <= 64 else F.from_json(F.lit(str(level.words)), T.ArrayType(T.LongType()))
    hit = F.lit(True)
    for slot in _slots(key, level, number):
        word = F.element_at(words, (F.floor(slot / 64) + 1).cast("int"))
        bit = F.pmod(slot, F.lit(64)).cast("int")
        hit = hit & (word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bit)) != 0)
    return hit


def _build(spark, keys: list[str], rate: float, number: int) -> Level:
    """A filter over the keys, whose bits Spark's own hash sets, so scans and builds agree."""
    n = max(1, len(keys))
    hashes = max(1, round(-math.log2(rate)))
    bits = max(64, math.ceil(n * hashes / math.log(2) / 64) * 64)
    level = Level([0] * (bits // 64), bits, hashes)
    if keys:
        frame = spark.createDataFrame([(k,) for k in keys], "key string")
        for row in frame.select(*[s.alias(f"s{i}") for i, s in enumerate(_slots(F.col("key"), level, number))]).toLocalIterator():
            for slot in row:
                level.words[slot // 64] |= 1 << (slot % 64)
    level.words = [w - (1 << 64) if w >= 1 << 63 else w for w in level.words]
    return level


def _passing(spark, keys: list[str], level: Level, number: int) -> list[str]:
    if not keys:
        return []
    frame = spark.createDataFrame([(k,) for k in keys], "key string")
    return [r[0] for r in frame.where(_passes(F.col("key"), level, number)).toLocalIterator()]


def build_cascade(universe: DataFrame, listed: list[str], n_universe: int) -> Cascade:
    """universe: a DataFrame with a column key, repeats allowed; n_universe: an upper bound of its distinct keys.

    An empty list gives an empty cascade, which holds no key."""
    spark = universe.sparkSession
    listed = sorted(set(listed))
    if not listed:
        return Cascade()
    if len(listed) > BLOCK_KEYS:
        raise ValueError(f"{len(listed)} keys; split them into blocks of {BLOCK_KEYS}")
    first = min(LEVEL_RATE, max(2.0**-30, len(listed) * math.sqrt(0.5) / max(1, n_universe - len(listed))))
    out = Cascade([_build(spark, listed, first, 1)])
    through = universe.where(F.col("key").isNotNull() & _passes(F.col("key"), out.levels[0], 1)).select("key").distinct()
    inside, outside = listed, sorted({r[0] for r in through.toLocalIterator()} - set(listed))
    while outside:
        number = len(out.levels) + 1
        out.levels.append(_build(spark, outside, LEVEL_RATE, number))
        inside, outside = outside, _passing(spark, inside, out.levels[-1], number)
    return out


def member(key: Column, cascade: Cascade) -> Column:
    """Whether a key of the universe is listed."""
    if not cascade.levels:
        return F.lit(False)
    answer = F.lit(len(cascade.levels) % 2 == 1)
    for number in range(len(cascade.levels), 0, -1):
        answer = F.when(_passes(key, cascade.levels[number - 1], number), answer).otherwise(F.lit(number % 2 == 0))
    return answer


def judge_urls(df: DataFrame, rules: list[Rule], url_col: str = "url", default: str = "allow") -> DataFrame:
    """df with host, path, rule and verdict added; columns of those names in df give way to these.

    A rule fits its host and all subdomains if the path starts with the rule's path; the longest fitting rule decides,
    and where none fits rule is null and the verdict the default. A null or empty URL, or one without '://', fits no rule.
    Repeated rows are judged each; an empty table gives an empty one."""
    host, path = url_parts(F.col(url_col))
    base = df.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    if not rules:
        return base.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    keys = candidate_keys(F.col("host"), F.col("path"), rules)
    universe = base.select(F.explode(keys).alias("key"))
    total = universe.count()
    verdicts = {"block": [r.key for r in rules if r.verdict == "block"], "allow": [r.key for r in rules if r.verdict == "allow"]}
    cascades = {v: [build_cascade(universe, ks[i : i + BLOCK_KEYS], total) for i in range(0, len(ks), BLOCK_KEYS)] for v, ks in verdicts.items()}

    def listed(key: Column, verdict: str) -> Column:
        hit = F.lit(False)
        for cascade in cascades[verdict]:
            hit = hit | member(key, cascade)
        return hit

    hits = F.transform(
        keys, lambda k: F.struct(k.alias("rule"), F.when(listed(k, "block"), F.lit("block")).when(listed(k, "allow"), F.lit("allow")).alias("verdict"))
    )
    best = F.get(F.filter(hits, lambda h: h["verdict"].isNotNull()), F.lit(0))
    return base.withColumn("_best", best).withColumns({"rule": F.col("_best.rule"), "verdict": F.coalesce(F.col("_best.verdict"), F.lit(default))}).drop("_best")
