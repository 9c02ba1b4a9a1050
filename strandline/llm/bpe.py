"""Byte-level BPE encoding and decoding with recursive DuckDB queries.

Each task has its own in-memory DuckDB with the merge table (pair of ids ->
rank, which is the merged id). New words of a batch of documents start as one
token per byte, with the rank of each position's pair. A recursive query
contracts each word's leftmost pair of the smallest rank and joins the two
positions beside it to the merge table, until no word has a pair left. Decoding
joins ids to the vocabulary and concatenates the pieces in an aggregation
ordered by position.

A word of more than CHUNK bytes is contracted in overlapping chunks. Two
encodings whose overlap holds the same token at the same place can be spliced
there: a list of tokens is the encoding of its text if and only if every two
neighbours are that of theirs, and all neighbours of the spliced list stand
side by side in one of the two. Chunks that share no token grow until they do,
in the end to the whole word, so the result is always that of the whole word.

A word is a match of the tokenizer's pattern. Words recur, so a task keeps the
ids and bytes of those it has met, up to a fixed number, and only new ones go
through the queries. Nothing is shuffled: documents are independent.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm._store import released, text_or_empty

#: Words kept during a task, about 350 bytes each; beyond that only those that came up again stay.
MEMO_WORDS = 300_000
#: New words that are looked up together: so many, or so many characters unless one word has more.
QUERY_WORDS, QUERY_CHARS = 40_000, 600_000
#: What one recursive query takes: bytes, and squares of lengths, as a word of n bytes leaves up to n states of n tokens.
QUERY_BYTES, QUERY_SQUARES = 400_000, 12_000_000
#: Bytes of a chunk of a longer word, at first; chunks overlap by half.
CHUNK = 32
#: A chunk that would have to grow beyond this becomes its whole word.
MAX_CHUNK = 1_536

#: The ASCII part of the tokenizer's pattern, where letters, digits and white space are plain ranges.
_ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\x09-\x0D\x20A-Za-z0-9]+|[\x09-\x0D\x20]+(?![^\x09-\x0D\x20])|[\x09-\x0D\x20]+"

#: The rank of a position whose pair is no token.
NO_RANK = 2**31 - 1

#: begun (word, ids, ranks: the rank of each pair of neighbours) contracted step by step.
_CONTRACT = """
WITH RECURSIVE state(word, ids, ranks) {keyed} AS (
    SELECT word, ids, ranks FROM begun
    {union}
    SELECT word, ids[:spot - 1] || [low] || ids[spot + 2:],
           CASE WHEN spot > 1 THEN ranks[:spot - 2] || [coalesce(l.merged, 2147483647)] ELSE [] END
           || CASE WHEN spot < len(ranks) THEN [coalesce(r.merged, 2147483647)] ELSE [] END || ranks[spot + 2:]
    FROM (SELECT *, list_position(ranks, low) AS spot FROM (SELECT *, list_min(ranks) AS low FROM state) WHERE low < 2147483647) AS s
    LEFT JOIN merges AS l ON l.pair = (ids[spot - 1]::UINTEGER * 65536 + low)::UINTEGER
    LEFT JOIN merges AS r ON r.pair = (low::UINTEGER * 65536 + ids[spot + 2])::UINTEGER)
SELECT word, ids FROM state WHERE len(ranks) = 0 OR list_min(ranks) = 2147483647
"""
_SHORT = _CONTRACT.format(keyed="", union="UNION ALL")
#: The same with one state of each word in memory, for whole long words.
_WHOLE = _CONTRACT.format(keyed="USING KEY (word)", union="UNION")

#: For long words whose chunks never met, as of repeated letters: one row per token position; every occurrence of the
#: smallest pair goes in one round. That equals contracting from the left unless a contraction opens a pair of a smaller
#: rank: bad says so, and the word is contracted step by step.
_CONTRACT_ALL = """
WITH RECURSIVE state(step, word, pos, id, was, bad) AS (
    SELECT 0, word, unnest(range(len(ids))), unnest(ids), -1, false FROM begun
    UNION ALL
    SELECT step + 1, word, pos, CASE WHEN turn % 2 = 1 THEN low ELSE id END, low, bad OR low < was OR twisted
    FROM (
        SELECT *, lag(turn) OVER (PARTITION BY word ORDER BY pos) AS turn_before
        FROM (
            SELECT *, CASE WHEN merged = low THEN row_number() OVER (PARTITION BY word, stretch, merged = low ORDER BY pos) END AS turn
            FROM (
                SELECT *, sum(CASE WHEN merged = low THEN 0 ELSE 1 END) OVER (PARTITION BY word ORDER BY pos) AS stretch,
                       coalesce(bool_or(merged = low AND twist) OVER (PARTITION BY word), false) AS twisted
                FROM (
                    SELECT s.*, merged, twist, min(merged) OVER (PARTITION BY word) AS low
                    FROM (SELECT *, lead(id) OVER (PARTITION BY word ORDER BY pos) AS following FROM state) AS s
                    LEFT JOIN merges ON pair = (id::UINTEGER * 65536 + following)::UINTEGER)
                WHERE low IS NOT NULL)))
    WHERE turn_before IS NULL OR turn_before % 2 = 0)
SELECT word, list(id ORDER BY pos) AS ids, bool_or(bad) AS bad
FROM state SEMI JOIN (SELECT word, max(step) AS step FROM state GROUP BY word) AS last USING (word, step) GROUP BY word
"""

#: The words of a table with their ids in decimal and the bytes, as Latin-1 characters, that the ids decode to.
_DECODE = """
SELECT word, array_to_string(ids, ' ') AS decimal, piece
FROM {table} LEFT JOIN (
    SELECT word, string_agg(piece, '' ORDER BY pos) AS piece
    FROM (SELECT word, unnest(ids) AS id, unnest(range(len(ids))) AS pos FROM {table}) JOIN vocabulary USING (id) GROUP BY word) USING (word)
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a vocabulary file with one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Tokenizer:
    """Encoder and decoder of one vocabulary; one per Python worker."""

    def __init__(self, path: str, pattern: str, memory: str = "160MB"):
        ranks = read_ranks(path)
        if len(ranks) > 1 << 16:
            raise ValueError("pairs of ids are packed into 32 bits")
        self._ranks, self._bytes = ranks, np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self._full = regex.compile(pattern)
        self._plain = re.compile(_ASCII_PATTERN) if pattern == _default_pattern() else self._full
        pairs, merged, twist = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs.append(left << 16 | right)
                    merged.append(rank)
                    twist.append(ranks.get(token + token[:i], rank) < rank)
        self._pair_ranks = np.full((256, 256), NO_RANK, np.int32)
        for token, rank in ranks.items():
            if len(token) == 2:
                self._pair_ranks[token[0], token[1]] = rank
        self.memo_words = MEMO_WORDS
        self._sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        self._sizes[list(ranks.values())] = [len(t) for t in ranks]
        self._db = duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": ""})  # nothing spills to a local disk
        self._db.execute("SET preserve_insertion_order = false")
        given = pa.table({"pair": pa.array(pairs, pa.uint32()), "merged": pa.array(merged, pa.int32()), "twist": twist})
        pieces = pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "piece": [t.decode("latin-1") for t in ranks]})
        for name, rows in (("merges", given), ("vocabulary", pieces)):
            self._db.register("given", rows)
            self._db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self._db.unregister("given")
        self._decimal: dict[str, str] = {}
        self._piece: dict[str, bytes] = {}
        self._again: set[str] = set()

    def split(self, text: str) -> list[str]:
        return (self._plain if text.isascii() else self._full).findall(text)

    def _contract(self, words: list[bytes]) -> None:
        """Leave the words' ids in the DuckDB table coded (word, their number in the list; ids): a whole word that is a token
        keeps its rank, others are contracted from single bytes."""
        self._db.sql("CREATE OR REPLACE TEMP TABLE coded (word INTEGER, ids INTEGER[])")
        whole = [(i, r) for i, w in enumerate(words) if (r := self._ranks.get(w)) is not None]
        known = {i for i, _ in whole}
        self._add([i for i, _ in whole], np.array([r for _, r in whole], np.int32), np.arange(len(whole) + 1))
        short = [i for i, w in enumerate(words) if len(w) <= CHUNK and i not in known]
        for part in self._parts([len(words[i]) for i in short]):
            self._insert([words[i] for i in short[part]], short[part])
        long = [i for i, w in enumerate(words) if len(w) > CHUNK and i not in known]
        for at in range(0, len(long), 2_000):
            part = long[at : at + 2_000]
            self._add(part, *self._spliced([words[i] for i in part]))

    def _insert(self, raw: list[bytes], numbers: list[int]) -> None:
        """Contract words of at most CHUNK bytes into coded."""
        self._db.register("begun", self._begun(raw, numbers))
        try:
            self._db.execute(f"INSERT INTO coded {_SHORT}")
        except duckdb.OutOfMemoryException:
            if len(raw) == 1:
                raise
            half = len(raw) // 2
            self._insert(raw[:half], numbers[:half])
            self._insert(raw[half:], numbers[half:])

    def _add(self, numbers: list[int], flat: np.ndarray, offsets: np.ndarray) -> None:
        if numbers:
            self._db.register("done", pa.table({"word": pa.array(numbers, pa.int32()), "ids": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.astype(np.int32)))}))
            self._db.execute("INSERT INTO coded SELECT word, ids FROM done")

    @staticmethod
    def _parts(lengths: list[int]) -> Iterator[slice]:
        """Runs of words that one query takes."""
        start, size, squares = 0, 0, 0
        for i, n in enumerate(lengths):
            if i > start and (size + n > QUERY_BYTES or squares + n * n > QUERY_SQUARES):
                yield slice(start, i)
                start, size, squares = i, 0, 0
            size, squares = size + n, squares + n * n
        if start < len(lengths):
            yield slice(start, len(lengths))

    def _begun(self, raw: list[bytes], numbers: list[int]) -> pa.Table:
        """The words as one token per byte with the ranks of their pairs."""
        data, lengths = np.frombuffer(b"".join(raw), np.uint8), np.array([len(w) for w in raw], np.int32)
        ends = np.cumsum(lengths)
        inside = np.ones(max(0, len(data) - 1), bool)
        inside[ends[:-1] - 1] = False
        ranks = self._pair_ranks[data[:-1], data[1:]][inside]
        lists = lambda counts, values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))
        return pa.table({"word": pa.array(numbers, pa.int32()), "ids": lists(lengths, self._bytes[data]), "ranks": lists(lengths - 1, ranks)})

    def _encodings(self, raw: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece, contracted on its own."""
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(raw)
        small = [i for i, w in enumerate(raw) if len(w) <= MAX_CHUNK]
        for part in self._parts([len(raw[i]) for i in small]):
            self._fetch(_SHORT, [raw[i] for i in small[part]], small[part], out)
        for i, w in enumerate(raw):
            if len(w) > MAX_CHUNK:
                self._db.register("begun", self._begun([w], [i]))
                bad = self._db.sql(f"SELECT bad FROM ({_CONTRACT_ALL})").fetchall()[0][0]
                self._fetch(_WHOLE if bad else f"SELECT word, ids FROM ({_CONTRACT_ALL})", [w], [i], out)
        return out

    def _fetch(self, query: str, raw: list[bytes], numbers: list[int], out: list[np.ndarray]) -> None:
        self._db.register("begun", self._begun(raw, numbers))
        try:
            found = self._db.sql(query).to_arrow_table()
        except duckdb.OutOfMemoryException:
            if len(raw) == 1:
                raise
            half = len(raw) // 2
            self._fetch(query, raw[:half], numbers[:half], out)
            self._fetch(query, raw[half:], numbers[half:], out)
            return
        ids = found["ids"].combine_chunks()
        offsets, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
        for i, a, b in zip(found["word"].to_pylist(), offsets, offsets[1:]):
            out[i] = flat[a:b]

    def _spliced(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of long words, one after the other, and where each word's begin: contracted in chunks, spliced at tokens
        that neighbours share."""
        spans = [(k, s, min(s + CHUNK, len(w))) for k, w in enumerate(words) for s in range(0, max(1, len(w) - CHUNK // 2), CHUNK // 2)]
        held: dict[tuple[int, int, int], np.ndarray] = {}
        while True:
            new = [x for x in spans if x not in held]
            held.update(zip(new, self._encodings([words[k][s:e] for k, s, e in new])))
            word, start, end = (np.array(c, np.int64) for c in zip(*spans))
            lists = [held[x] for x in spans]
            flat, counts = np.concatenate(lists), np.array([len(x) for x in lists])
            of = np.repeat(np.arange(len(spans)), counts)
            upto = np.cumsum(self._sizes[flat])
            begins = np.concatenate([[0], upto[:-1]])
            place = begins - np.repeat(begins[np.cumsum(counts) - counts], counts) + start[of]  # of a token in its word
            joint = np.flatnonzero(word[:-1] == word[1:])  # between a span and the next one
            is_joint = np.zeros(len(spans) + 1, bool)
            is_joint[joint] = True
            after = np.append(start[1:], 0)  # where the next span begins
            left = is_joint[of] & (place >= after[of])
            right = (of > 0) & is_joint[of - 1] & (place < end[of - 1])
            tag = lambda k, at, i: k << 36 | at << 16 | i
            shared = np.intersect1d(tag(of[left], place[left] - after[of[left]], flat[left]), tag(of[right] - 1, place[right] - start[of[right]], flat[right]))
            first, where = np.unique(shared >> 36, return_index=True)
            cut = np.full(len(spans), -1, np.int64)
            cut[first] = (shared[where] >> 16 & 0xFFFFF) + after[first]
            low = np.where(np.append(False, is_joint[: len(spans) - 1]), np.append(0, cut[:-1]), 0)
            failed = is_joint[: len(spans)] & ((cut < 0) | (cut < low))
            if not failed.any():
                high = np.where(is_joint[: len(spans)], cut, np.iinfo(np.int64).max)
                keep = (place >= low[of]) & (place < high[of])
                return flat[keep], np.concatenate([[0], np.cumsum(np.bincount(word[of[keep]], minlength=len(words)))])
            spans = self._regrown(spans, failed, words)

    @staticmethod
    def _regrown(spans: list[tuple[int, int, int]], failed: np.ndarray, words: list[bytes]) -> list[tuple[int, int, int]]:
        """The spans, with every run of them that failed to meet cut anew into spans three times as long."""
        out, i = [], 0
        while i < len(spans):
            j = i
            while failed[j]:
                j += 1
            if j == i:
                out.append(spans[i])
            else:
                k, begin, end = spans[i][0], spans[i][1], spans[j][2]
                size = 3 * max(e - s for _, s, e in spans[i : j + 1])
                if size > MAX_CHUNK:  # the whole word, in place of all its spans
                    while out and out[-1][0] == k:
                        out.pop()
                    while j + 1 < len(spans) and spans[j + 1][0] == k:
                        j += 1
                    out.append((k, 0, len(words[k])))
                else:
                    out += [(k, s, min(s + size, end)) for s in range(begin, max(begin + 1, end - size // 2), size // 2)]
            i = j + 1
        return out

    def _decoded(self, table: str = "coded") -> Iterator[tuple[int, str, bytes]]:
        """(word, ids in decimal, bytes) of the table coded, or of halves of it where it is too much at once."""
        try:
            found = self._db.sql(_DECODE.format(table=table)).to_arrow_table()
        except duckdb.OutOfMemoryException:
            low, high = self._db.sql(f"SELECT min(word), max(word) FROM {table}").fetchall()[0]
            if low == high:
                raise
            for k, span in enumerate((f"word <= {(low + high) // 2}", f"word > {(low + high) // 2}")):
                half = f"{table}_{k}"
                self._db.sql(f"CREATE OR REPLACE TEMP TABLE {half} AS SELECT * FROM {table} WHERE {span}")
                yield from self._decoded(half)
                self._db.sql(f"DROP TABLE {half}")
            return
        for i, decimal, piece in zip(*(found[k].to_pylist() for k in ("word", "decimal", "piece"))):
            yield i, decimal or "", (piece or "").encode("latin-1")

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of each word."""
        self._contract([w.encode("utf-8", "surrogatepass") for w in words])
        out: list[list[int]] = [[]] * len(words)
        for i, decimal, _ in self._decoded():
            out[i] = [int(x) for x in decimal.split()]
        return out

    def decode_lists(self, lists: list[list[int]]) -> list[bytes]:
        """The bytes of each list of ids."""
        self._db.register("fresh", pa.table({"word": pa.array(range(len(lists)), pa.int32()), "ids": pa.array(lists, pa.list_(pa.int32()))}))
        self._db.sql("CREATE OR REPLACE TEMP TABLE coded AS SELECT word, ids FROM fresh")
        out = [b""] * len(lists)
        for i, _, piece in self._decoded():
            out[i] = piece
        return out

    def learn(self, words: set[str]) -> None:
        """Have the words' ids and decoded bytes in the memo."""
        new = [w for w in words if w not in self._decimal]
        at = 0
        while at < len(new):
            end, size = at, 0
            while end < len(new) and end - at < QUERY_WORDS and (end == at or size + len(new[end]) <= QUERY_CHARS):
                size += len(new[end])
                end += 1
            part, at = new[at:end], end
            self._contract([w.encode("utf-8", "surrogatepass") for w in part])
            for i, decimal, piece in self._decoded():
                self._decimal[part[i]] = decimal
                self._piece[part[i]] = piece

    def forget(self) -> None:
        """Drop the memo, so that what a worker does next has its memory."""
        self._decimal, self._piece, self._again = {}, {}, set()
        self._db.sql("CREATE OR REPLACE TEMP TABLE coded (word INTEGER, ids INTEGER[])")
        pa.default_memory_pool().release_unused()

    def documents(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """For each text its ids in decimal, joined by one space, and the bytes that they decode to."""
        words = [self.split(t) for t in texts]
        block = set().union(*words)
        if len(self._decimal) > self.memo_words:
            stay = self._again if len(self._again) < self.memo_words // 2 else set()
            self._decimal, self._piece = {w: self._decimal[w] for w in stay}, {w: self._piece[w] for w in stay}
            self._again = set()
        self._again |= block & self._decimal.keys()
        self.learn(block)
        decimal, piece = self._decimal.__getitem__, self._piece.__getitem__
        for ws in words:
            yield " ".join(map(decimal, ws)), b"".join(map(piece, ws))


def _default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(maxsize=2)
def worker_tokenizer(path: str, pattern: str) -> Tokenizer:
    """The worker's tokenizer; its tables outlive a task, its memo doesn't."""
    return Tokenizer(path, pattern)


#: Characters of text whose words are looked up together.
BLOCK_CHARS = 2_500_000


def _blocks(texts: Iterable[str]) -> Iterator[list[str]]:
    block, size = [], 0
    for t in texts:
        block.append(t)
        size += len(t)
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def encode_documents(df: DataFrame, path: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, memo_words: int = MEMO_WORDS) -> DataFrame:
    """One row per row of df: the id, ids (array of int, if keep_ids), n_tokens, ids_sha256, decoded_sha256.

    path is the vocabulary's place on every worker; memo_words rules how many words a task keeps with their ids. Each match of the pattern is encoded on its own, without special
    tokens; a null text counts as empty and has no tokens. decoded_sha256 is of the bytes that the ids decode to. Repeated
    rows come out each; an empty table gives an empty one."""
    pattern = pattern or _default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = worker_tokenizer(path, pattern)
        tok.memo_words = memo_words
        for b in batches:
            start = 0
            for block in _blocks(t.as_py() for t in b["text"]):  # a block's results go out before the next one's are made
                found = list(tok.documents(block))
                counts = [joined.count(" ") + 1 if joined else 0 for joined, _ in found]
                columns = [b["id"].slice(start, len(block))]
                start += len(block)
                if keep_ids:
                    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    flat = np.fromstring(" ".join(joined for joined, _ in found if joined), np.int32, sep=" ") if offsets[-1] else np.empty(0, np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
                columns += [pa.array(counts, pa.int64()), *[pa.array([hashlib.sha256(x).hexdigest() for x in texts]) for texts in ((j.encode() for j, _ in found), (d for _, d in found))]]
                yield pa.RecordBatch.from_arrays(columns, names=["id", *["ids"] * keep_ids, "n_tokens", "ids_sha256", "decoded_sha256"])
        tok.forget()

    rows = df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    schema = "id long, " + "ids array<int>, " * keep_ids + "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(released(run), schema).withColumnRenamed("id", id_col)


def decode_documents(df: DataFrame, path: str, pattern: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of df: the id and decoded (binary), the bytes of the array of ids; null or empty ids give no bytes."""
    pattern = pattern or _default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = worker_tokenizer(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(tok.decode_lists([x or [] for x in b["ids"].to_pylist()]), pa.binary())], names=["id", "decoded"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(released(run), "id long, decoded binary").withColumnRenamed("id", id_col)
