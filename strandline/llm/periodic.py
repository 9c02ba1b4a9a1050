"""Runs of words that repeat with a period, found by probing a harmonic grid.

A stretch of at least four periods p holds a stretch of 3p words that equal the word p further on, so three grid points
jp, (j+1)p, (j+2)p lie in it. For every p only the words at multiples of p are compared with the next one; what survives
three equal probes, and some more at fixed offsets behind them, is extended to both sides by comparing arrays in chunks.
The grid has n/p points for p, n ln n in all. Grid points inside a run whose period divides p are skipped.

Texts are probed together: words become numbers, texts are laid end to end with a number of its own between any two, so
that no run crosses a border, longest text first, so that a period is only probed where texts are long enough for it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A run has at least so many words and so many periods.
LEAST_WORDS = 6
LEAST_PERIODS = 4
#: Words that are probed together, unless one text has more.
BATCH_WORDS = 300_000
_CHUNK = 32


def _stretch(a: np.ndarray, i: int, p: int) -> tuple[int, int]:
    """The longest low..high (end exclusive) around i within which every word equals the one p further on."""
    low, high, step = i, i + 1, _CHUNK
    most = len(a) - p
    while high < most:
        differ = np.flatnonzero(a[high : min(high + step, most)] != a[high + p : min(high + step, most) + p])
        if len(differ):
            high += int(differ[0])
            break
        high, step = min(high + step, most), step * 2
    step = _CHUNK
    while low > 0:
        at = max(low - step, 0)
        differ = np.flatnonzero(a[at:low] != a[at + p : low + p])
        if len(differ):
            low = at + int(differ[-1]) + 1
            break
        low, step = at, step * 2
    return low, high


def periodic_runs(a: np.ndarray, longest: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of an array of numbers, by start, then period.

    longest, where a holds several texts: (number of words, end in a) of each, by falling number."""
    longest = longest or [(len(a), len(a))]
    found: dict[tuple[int, int], int] = {}
    owner, owned_to = np.zeros(len(a), np.int32), np.zeros(len(a), np.int64)
    at = len(longest) - 1
    for p in range(1, longest[0][0] // LEAST_PERIODS + 1):
        while longest[at][0] < LEAST_PERIODS * p:
            at -= 1
        end = longest[at][1]
        equal = a[0 : end - p : p] == a[p:end:p]
        start = np.flatnonzero(equal[:-2] & equal[1:-1] & equal[2:]) * p
        if not len(start):
            continue
        q = owner[start]
        start = start[(q == 0) | (p % np.maximum(q, 1) != 0) | (start + 2 * p > owned_to[start])]
        for offset in {1, p // 3, p // 2, p - 1, p + 1, p + p // 2, 2 * p - 1} if p > 1 else ():
            start = start[a[start + offset] == a[start + offset + p]]
        done = -1
        for i in start.tolist():
            if i < done:
                continue
            low, done = _stretch(a, i, p)
            stop = done + p
            if stop - low < max(LEAST_WORDS, LEAST_PERIODS * p) or (low, stop) in found:
                continue
            found[low, stop] = p
            free = owned_to[low:stop] < stop
            owner[low:stop][free] = p
            owned_to[low:stop][free] = stop
    return sorted((s, e - s, p) for (s, e), p in found.items())


def repeat_tail(words: list[bytes], doc_id) -> list[bytes]:
    """The words with the repetition that the id of one text in ten asks for; a null id asks for none."""
    if doc_id is None or not words:
        return words
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return words
    n, a = len(words), g % len(words)
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def _digests(texts: list[list[bytes]]) -> list[tuple]:
    """n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 of each text."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    numbers: dict[bytes, int] = {}
    a = np.empty(sum(map(len, texts)) + len(texts), np.int32)
    starts, longest, at = [], [], 0
    for k, i in enumerate(order):
        n = len(texts[i])
        a[at : at + n] = np.fromiter((numbers.setdefault(w, len(numbers)) for w in texts[i]), np.int32, n)
        a[at + n] = -1 - k
        starts.append(at)
        longest.append((n, at + n + 1))
        at += n + 1
    keep, runs = np.ones(len(a), bool), [[] for _ in texts]
    if order:
        found = periodic_runs(a, longest)
        owners = np.searchsorted(starts, [s for s, _, _ in found], "right") - 1
        for (s, length, q), k in zip(found, owners.tolist()):
            keep[s + q : s + length] = False
            runs[k].append((s - starts[k], length, q))
    out: list[tuple] = [()] * len(texts)
    for k, i in enumerate(order):
        words = texts[i]
        if runs[k]:
            words = compress(words, keep[starts[k] : starts[k] + len(words)].tolist())
            s, length, q = max(runs[k], key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
            best = (s, length, q, 1000 * length // q)
        else:
            best = (None,) * 4
        said = "".join(f"{s},{length},{q}\n" for s, length, q in runs[k])
        out[i] = (len(runs[k]), *best, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest())
    return out


_RESULT = [("n_runs", T.LongType()), ("start", T.LongType()), ("length", T.LongType()), ("period", T.LongType()), ("exponent_milli", T.LongType()), ("runs_sha256", T.StringType()), ("collapsed_sha256", T.StringType())]


def _digester(planted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.string()] * 2

        def flush(ids: list, texts: list[list[bytes]], kind) -> pa.RecordBatch:
            columns = zip(*_digests(texts))
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=["id", *[n for n, _ in _RESULT]])

        for batch in batches:
            ids, texts, held = [], [], 0
            for i, text in zip(batch.column(0), batch.column(1)):
                key = i.as_py()
                words = (text.as_py() or b"").split()  # bytes split at exactly \x20 and \x09-\x0D
                words = repeat_tail(words, key) if planted else words
                ids.append(key)
                texts.append(words)
                held += len(words)
                if held >= BATCH_WORDS:
                    yield flush(ids, texts, batch.schema.field(0).type)
                    ids, texts, held = [], [], 0
            if ids:
                yield flush(ids, texts, batch.schema.field(0).type)

    return run


def collapse_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", planted: bool = False) -> DataFrame:
    """One row per row of df: the id, n_runs, the run of the greatest exponent (start, length, period, exponent_milli), and
    the SHA-256 of all runs and of the text without what repeats.

    Words are split at ASCII white space. A run is a maximal stretch of a smallest period q, of at least max(6, 4q) words;
    of each run the words behind the first q go. Of equal exponents the run that begins first is given, then the one of the
    smaller period. A null or empty text has no run: nulls, and the SHA-256 of nothing. Repeated rows come out each, an
    empty table gives an empty one, other columns are left out. With planted, one text in ten gets a repetition first, as
    its id asks for; a null id asks for none. Nothing is shuffled; a task holds one Arrow batch, and of the whole texts in
    it BATCH_WORDS words, or one text, as numbers."""
    kind = df.schema[id_col].dataType
    asked = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    schema = T.StructType([T.StructField("id", kind), *[T.StructField(n, t) for n, t in _RESULT]])
    return asked.mapInArrow(_digester(planted), schema).withColumnRenamed("id", id_col)
