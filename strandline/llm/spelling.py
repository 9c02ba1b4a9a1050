"""Spelling variants: words one edit apart, by Aho-Corasick automata over the halves of words.

One edit leaves one half of a word as it was: the first half at offset 0, or the second half at the end. Automaton shards
hold the halves of the words; a word is scanned by the shards that can hold a half of a word near it. A hit counts if the
half stands at its offset and the lengths fit. Which of the words with that half are compared is looked up by one quarter
of the other half, as one edit in the other half leaves one of its own halves as it was. The distance is then verified.

A shard holds the halves of about SHARD_WORDS words, so there are more shards for more words. A half that very many words
share is spread over shards by the quarters, so no shard gets all words of a frequent half. Every near word is met once:
a pair that is found in several ways counts in the first of them.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm._store import materialize

LEAST_LETTERS = 7
LEAST_COUNT = 2
#: A form is at least so many times as frequent.
TIMES = 10
#: Words whose halves a shard holds, on average.
SHARD_WORDS = 20_000
#: A half is frequent if it belongs to more than SHARD_WORDS words and one in so many; so there are fewer than twice as many.
FREQUENT = 10_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", dropped: int = 31) -> DataFrame:
    """word, n: the words of at least LEAST_LETTERS letters and LEAST_COUNT occurrences.

    Letters are A-Z, a-z and U+00C0 to U+00FF, only A-Z are lower-cased. Where dropped divides the CRC-32 of id and word,
    one letter is left out. A null id counts as an empty one, a null text has no words."""
    run = F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(rf"[A-Za-zÀ-ÿ]{{{LEAST_LETTERS},}}"), F.lit(0)))
    runs = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), run.alias("run")).withColumn("run", F.translate("run", _UPPER, _LOWER))
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % dropped == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def quarters(length: int) -> tuple[int, int, int, int]:
    """Where a word of that length is cut: the middle of the first half, the middle, and the middle of the second half; and the length."""
    half = length // 2
    return half // 2, half, half + (length - half) // 2, length


def quarter_of(word: str, length: int, side: int, kind: int) -> str:
    """The quarter of a word as a word of that length would have it: side is the half that is equal, kind says which quarter of the other one."""
    a, half, b, _ = quarters(length)
    if side == 0:  # the first half is equal: the third quarter in its place, or the fourth at the end
        return word[half:b] if kind == 0 else word[len(word) - (length - b) :]
    at = len(word) - length
    return word[:a] if kind == 0 else word[at + a : at + half]


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced character makes b of a."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    i, n = 0, len(b)
    while i < n and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == (b[i + 1 :] if len(a) == n else b[i:])


class Shard:
    """An automaton over the halves that were dealt to this shard, and behind each half its words by length and quarter."""

    def __init__(self) -> None:
        self.cells: dict[tuple[int, str, int, int, str], list[tuple[str, int]]] = defaultdict(list)
        self.halves: dict[str, int] = defaultdict(int)
        self.automaton = ahocorasick.Automaton()

    def add(self, word: str, n: int, side: int, kinds: tuple[int, ...]) -> None:
        middle = len(word) // 2
        half = word[:middle] if side == 0 else word[middle:]
        self.halves[half] |= 1 << side
        for kind in kinds:
            self.cells[side, half, len(word), kind, quarter_of(word, len(word), side, kind)].append((word, n))

    def close(self) -> None:
        for half, sides in self.halves.items():
            self.automaton.add_word(half, (half, sides))
        if self.halves:
            self.automaton.make_automaton()

    def near(self, word: str) -> Iterator[tuple[str, int]]:
        """The words one edit from word that are met here and not by an earlier way elsewhere."""
        if not self.halves:
            return
        size, cells = len(word), self.cells
        for last, (half, sides) in self.automaton.iter(word):
            m = len(half)
            at_start, at_end = sides & 1 and last == m - 1, sides & 2 and last == size - 1
            if not (at_start or at_end):
                continue
            for length in (size - 1, size, size + 1):
                middle = length // 2
                if at_start and m == middle:
                    for kind in (0, 1):
                        for other, n in cells.get((0, half, length, kind, quarter_of(word, length, 0, kind)), ()):
                            if one_edit(word, other) and (kind == 0 or quarter_of(word, length, 0, 0) != quarter_of(other, length, 0, 0)):
                                yield other, n
                if at_end and m == length - middle:
                    for kind in (0, 1):
                        for other, n in cells.get((1, half, length, kind, quarter_of(word, length, 1, kind)), ()):
                            if one_edit(word, other) and word[:middle] != other[:middle] and (kind == 0 or quarter_of(word, length, 1, 0) != quarter_of(other, length, 1, 0)):
                                yield other, n


def _scan(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Of one shard: the words to hold (left) and the words to scan (right); how many are near, and the most frequent of them."""
    shard = Shard()
    for word, n, side, kind in zip(left["word"], left["n"], left["side"], left["kind"]):
        shard.add(word, n, side, (0, 1) if kind < 0 else (kind,))
    shard.close()
    words, sums, best_n, best = [], [], [], []
    for word in right["asked"]:
        count, top = 0, None
        for other, n in shard.near(word):
            count += 1
            if top is None or (-n, other) < top:
                top = (-n, other)
        if count:
            words.append(word)
            sums.append(count)
            best_n.append(-top[0])
            best.append(top[1])
    return pd.DataFrame({"word": pd.Series(words, dtype="str"), "near": pd.Series(sums, dtype="int64"), "best_n": pd.Series(best_n, dtype="int64"), "best": pd.Series(best, dtype="str")})


def _piece(word: Column, start: Column, stop: Column) -> Column:
    """Code points start to stop (exclusive, from 0)."""
    return F.when(stop > start, word.substr(start + 1, stop - start)).otherwise("")


def _ways(lengths: Column) -> Column:
    """Of column word, for each length that a near word can have and each side: side, length, the half and its two quarters."""
    word, size = F.col("word"), F.length("word")

    def of(length: Column) -> Column:
        half = F.floor(length / 2).cast("int")
        a, b = F.floor(half / 2).cast("int"), half + F.floor((length - half) / 2).cast("int")
        at = size - length
        first = F.struct(F.lit(0).alias("side"), length.alias("length"), _piece(word, F.lit(0), half).alias("half"), _piece(word, half, b).alias("q0"), _piece(word, at + b, size).alias("q1"))
        second = F.struct(F.lit(1).alias("side"), length.alias("length"), _piece(word, at + half, size).alias("half"), _piece(word, F.lit(0), a).alias("q0"), _piece(word, at + a, at + half).alias("q1"))
        return F.array(first, second)

    return F.flatten(F.transform(lengths, of))


def near_words(words: DataFrame, shard_words: int = SHARD_WORDS, frequent: int = FREQUENT) -> DataFrame:
    """word, n, n_near, form, form_n of a table of distinct words (word, n): see spelling_variants."""
    total = words.count()
    shards = max(1, math.ceil(total / shard_words))
    size = F.length("word")
    own = words.select("word", "n", F.explode(_ways(F.array(size))).alias("w")).select("word", "n", "w.*")
    asked = words.select("word", F.explode(_ways(F.array(size - 1, size, size + 1))).alias("w")).select("word", "w.*")
    hot = own.groupBy("side", "half").count().where(F.col("count") > F.greatest(F.lit(shard_words), F.lit(total / frequent))).select("side", "half", F.lit(True).alias("hot"))
    hot = F.broadcast(materialize(hot, "frequent-halves", 0))
    cold_shard = F.pmod(F.xxhash64("side", "half"), F.lit(shards)).cast("int")

    def dealt(rows: DataFrame) -> DataFrame:
        marked = rows.join(hot, ["side", "half"], "left")
        cells = F.when(F.col("hot"), F.array(*[F.struct(F.lit(k).alias("kind"), F.pmod(F.xxhash64("side", "half", "length", F.lit(k), f"q{k}"), F.lit(shards)).cast("int").alias("shard")) for k in (0, 1)]))
        return marked.withColumn("c", F.explode(F.coalesce(cells, F.array(F.struct(F.lit(-1).alias("kind"), cold_shard.alias("shard"))))))

    held = dealt(own).select("c.shard", "word", "n", "side", "c.kind")
    scanned = dealt(asked).select(F.col("c.shard").alias("at"), F.col("word").alias("asked")).distinct()
    met = held.groupBy("shard").cogroup(scanned.groupBy("at")).applyInPandas(_scan, "word string, near long, best_n long, best string")
    none = F.lit(None)
    rows = words.select("word", "n", F.lit(0).cast("long").alias("near"), none.cast("long").alias("best_n"), none.cast("string").alias("best")).unionByName(met.select("word", none.cast("long").alias("n"), "near", "best_n", "best"))
    top = F.min(F.when(F.col("best_n").isNotNull(), F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("form"))))
    found = rows.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), top.alias("t"))
    fits = -F.col("t.m") >= TIMES * F.col("n")
    return found.select("word", "n", "n_near", F.when(fits, F.col("t.form")).alias("form"), F.when(fits, -F.col("t.m")).alias("form_n"))


def with_roots(found: DataFrame) -> DataFrame:
    """found (word, form and more) with root: forms followed to the last one, the word itself if it has none.

    Each round doubles how far a root lies; counts grow tenfold with every form, so a handful of rounds ends it."""
    roots = materialize(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = materialize(roots.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        roots = moved.select("word", "root")
        if not moved.where("moved").take(1):
            return found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", dropped: int = 31) -> DataFrame:
    """word, form, root, n, n_near, form_n: every word of at least seven letters and two occurrences.

    n_near counts the words exactly one edit away. form is the most frequent of these, the smallest in code-point order on
    ties, if it is at least TIMES as frequent, else null as form_n; root follows forms to the last. A null text has no
    words, a null id counts as an empty one; repeated rows count each; without words the result is empty; other columns
    are not looked at."""
    words = materialize(word_counts(df, id_col, text_col, dropped), "words")
    found = materialize(near_words(words), "near-words")
    return with_roots(found).select("word", "form", "root", "n", "n_near", "form_n")
