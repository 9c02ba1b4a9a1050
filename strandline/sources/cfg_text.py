"""Control-flow graphs from dumped text.

A dump is split into lines once, and its headers, blocks and their parts are told in one pass over these where the dump is
read; no line is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

# The header of a block in the dump, and what no function's first line begins with. Letters, digits and blanks
# are ASCII's; a mark that ends a line elsewhere (next line, line and paragraph separator) may end one here too.
_BLOCK = re.compile(r"\s*\[(B\d+)\s*(?:\((\w+)\))?\]\s*[\x85\u2028\u2029]?\Z", re.ASCII)
_NO_FUNCTION = re.compile(r"\[B|Succs|Preds|T:|case|default|\d|ANALYZE", re.ASCII)
_LINE_END, _BLANKS, _INDENT, _NUMBER = re.compile(r"\r?\n"), re.compile(r"\s+", re.ASCII), re.compile(r"\s", re.ASCII), re.compile(r"\d+[\x85\u2028\u2029]?\Z", re.ASCII)
_BEHIND_BLANK = re.compile(r"\s[^\n\r\x85\u2028\u2029]*(?=[\n\r\x85\u2028\u2029]?\Z)", re.ASCII)
_LABELS = {"Preds": "predecessors", "Succs": "successors"}
# Blocks in a batch that goes back to Spark.
_BATCH_BLOCKS = 10_000
_PARTS = ["function_name", "block_id", "label", "statements", "terminator", "predecessors", "successors"]
_TYPES = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]


def _opens(lines: list[str], at: int) -> bool:
    """Whether a function begins here."""
    if ")" not in lines[at] or _NO_FUNCTION.match(lines[at].strip(" ")):
        return False
    first = next((t for x in lines[at + 1 : at + 4] if (t := x.strip(" "))), "")
    return first.startswith("[B")


def _kind(ahead: str, bracket: str) -> str | None:
    """The part that a line is of, by what is ahead of its colon and of its bracket; a statement begins with its number."""
    label = _BEHIND_BLANK.sub("", ahead)
    if _NUMBER.match(label):
        return "statements"
    return "terminator" if label == "T" else _LABELS.get(_BEHIND_BLANK.sub("", bracket.strip(" ")))


@lru_cache(4096)
def _kind_by_head(head: str) -> str | None:
    """The same of a line of ASCII, where nothing behind the colon counts: blanks end a label, and a colon is in none."""
    ahead = head.strip(" ")
    return _kind(ahead, ahead.partition("(")[0] if "(" in head or _BLANKS.search(head.lstrip(" ")) else "")


def _part(line: str) -> tuple[str, str] | None:
    """What an indented line says behind its label and the first colon, with its kind."""
    head, colon, said = line.partition(":")
    if not colon or not _INDENT.match(line):
        return None
    if line.isascii() and "\r" not in line:
        kind = _kind_by_head(head)
    else:
        text = line.strip(" ")
        kind = _kind(text.partition(":")[0], text.partition("(")[0])
    return (kind, said.strip(" ")) if kind else None


def scan(content: str) -> Iterator[tuple]:
    """The blocks of a dump, without its path."""
    lines = _LINE_END.split(content) if "\r" in content else content.split("\n")
    heads = [i for i, line in enumerate(lines) if "(" in line and _opens(lines, i)]
    last: dict[str, dict] = {}
    for at, end in zip(heads, [*heads[1:], len(lines)]):
        found: dict[str, tuple[list[str], dict[str, list[str]]]] = {}
        told: dict[str, list[str]] | None = None
        for line in lines[at + 1 : end]:
            if "[" in line and (head := _BLOCK.match(line)):
                labels, told = found.setdefault(head[1], ([], {"statements": [], "terminator": [], "predecessors": [], "successors": []}))  # a block that is listed twice is one
                labels.append(head[2] or "")
            elif told is not None and (part := _part(line)) and part[1]:
                told[part[0]].append(part[1])
        if found:
            last[lines[at].strip(" ")] = found
    for function, found in last.items():
        for block, (labels, told) in found.items():
            names = [[x for x in _BLANKS.split(max(told[c], default="")) if x] for c in ("predecessors", "successors")]
            yield function, block, max(labels), told["statements"], max(told["terminator"], default=None), *names


def _column(values: Sequence, kind: pa.DataType) -> pa.Array:
    if not pa.types.is_list(kind):
        return pa.array(values, kind)
    ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(list(chain.from_iterable(values)), pa.string()))


def blocks(dumps: DataFrame) -> DataFrame:
    """dumps (path, content) as one row per block: path, function_name, block_id, label, statements, terminator, predecessors, successors.

    A function begins at a line with brackets whose next line that is not blank (of three) opens a block. Of functions with
    one name the last wins. The first successor of a branching block is the one taken when its terminator holds. A path has
    one dump, so a dump is cut into functions and these into blocks where it is read, and nothing is shuffled."""
    path = dumps.schema["path"].dataType
    schema = pa.schema([("path", to_arrow_type(path)), *zip(_PARTS, _TYPES)])

    def emit(batch: pa.RecordBatch, at: list[int], found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())).cast(schema[0].type), *map(_column, list(zip(*found)) or [()] * len(_TYPES), _TYPES)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, content in enumerate(batch.column(1)):
                if (text := content.as_py()) is None:
                    continue
                for block in scan(text.decode("utf-8", "replace")):
                    at.append(i)
                    found.append(block)
                    if len(found) == _BATCH_BLOCKS:
                        yield emit(batch, at, found)
                        at, found = [], []
            yield emit(batch, at, found)

    kinds = ", ".join(f"{n} {'array<string>' if pa.types.is_list(t) else 'string'}" for n, t in zip(_PARTS, _TYPES))
    return dumps.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, f"path {path.simpleString()}, {kinds}")


def edges(found: DataFrame) -> DataFrame:
    """Flow edges of blocks: path, function_name, src, dst, position; position 0 is the branch taken when the terminator holds."""
    return found.select("path", "function_name", F.col("block_id").alias("src"), F.posexplode("successors").alias("position", "dst")).select(
        "path", "function_name", "src", F.regexp_replace("dst", r"\(.*\)", "").alias("dst"), "position"
    )
