"""Clang static analyzer HTML reports as findings, ordered steps and embedded source lines.

The balanced parts of a report (event boxes, code cells with pop-ups) are no regular language: one Arrow-batched pass
walks the report's markers once and emits rows. Typing of the steps is left to column expressions.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The comment names of a report's metadata.
METADATA = {
    "bug_type": "BUGTYPE", "bug_category": "BUGCATEGORY", "bug_file": "BUGFILE", "file_name": "FILENAME", "bug_line": "BUGLINE", "bug_column": "BUGCOLUMN",
    "bug_description": "BUGDESC", "function_name": "FUNCTIONNAME", "path_length": "BUGPATHLENGTH", "issue_hash": "ISSUEHASHCONTENTOFLINEINCONTEXT",
}
#: The number of a path's last event.
END_OF_PATH = 9999

# The ids and class names by which a report marks its parts.
FILE_NAME, LISTING, LISTING_LINE, LINE_NUMBER, BOX, LAST_BOX = "FileName", "code", "codeline", "data-linenumber", "msg", "EndPath"
POPUPS = frozenset({"macro_popup", "variable_popup"})

_TAG = re.compile(r"""<(/?)([A-Za-z][\w-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")


def _attributes(text: str) -> dict[str, str]:
    return {name.lower(): "".join(values) for name, *values in _ATTRIBUTE.findall(text)}


def _plain(markup: str) -> str:
    """Text without tags, a box's leading number left out."""
    words = entities.unescape(_TAG.sub(" ", markup)).split()
    return " ".join(words[1:] if len(words) > 1 and words[0].isdigit() else words)


def _marks(source: str) -> Iterator[tuple[str, str, int, int]]:
    """(mark, value, start, end) of the tags that matter: file, listing, line, box, open, close."""
    for m in _TAG.finditer(source):
        tag = m[2].lower()
        if tag == "div" and m[1]:
            yield "close", "", m.start(), m.end()
        if m[1] or tag not in ("h4", "table", "tr", "div"):
            continue
        has = _attributes(m[3])
        classes, name = has.get("class", "").split(), has.get("id", "")
        if tag == "h4" and FILE_NAME in classes:
            yield "file", _plain(source[m.end() : max(m.end(), source.find("</h4", m.end()))]), m.start(), m.end()
        elif tag == "table" and LISTING in classes:
            yield "listing", "", m.start(), m.end()
        elif tag == "tr" and LISTING_LINE in classes and has.get(LINE_NUMBER, "").isdigit():
            yield "line", has[LINE_NUMBER], m.start(), m.end()
        elif tag == "div":
            number = str(END_OF_PATH) if name == LAST_BOX else name.removeprefix("Path")
            kinds = [c.removeprefix(BOX) for c in classes if c.startswith(BOX) and c != BOX]
            if BOX in classes and kinds and number.isdigit() and number != name:
                yield "box", f"{number} {kinds[0].lower()}", m.start(), m.end()
            else:
                yield "open", "", m.start(), m.end()


def scan_events(source: str, fallback: str) -> list[dict]:
    """Event boxes in the order of their numbers, then of the document, each with the file and line it stands at.

    A code table belongs to the file named since the table before, else to the fallback; an event stands at the last code
    row before it. A box that isn't closed is no event."""
    found, open_boxes = [], []
    named = section = None
    line = 0
    for mark, value, start, end in _marks(source):
        if mark == "file":
            named = value
        elif mark == "listing":
            section, named = named or fallback, None
        elif mark == "line":
            line = int(value)
        elif mark == "box":
            number, kind = value.split(" ")
            open_boxes.append(({"path_number": int(number), "event_type": kind, "line": line, "file": section or fallback, "at": len(found) + len(open_boxes)}, end))
        elif mark == "open":
            open_boxes.append((None, end))
        elif open_boxes:
            event, begun = open_boxes.pop()
            if event:
                found.append(event | {"text": _plain(source[begun:start])})
    return sorted(found, key=lambda e: (e["path_number"], e["at"]))


def scan_lines(source: str, fallback: str) -> list[tuple[str, int, str]]:
    """(file, line, text) of the embedded listings, pop-ups left out."""
    out, named, section = [], None, None
    for mark, value, _, end in _marks(source):
        if mark == "file":
            named = value
        elif mark == "listing":
            section, named = named or fallback, None
        elif mark == "line":
            close = source.find("</tr>", end)
            out.append((section or fallback, int(value), _listed(source[end : close if close >= 0 else len(source)])))
    return out


def _listed(row: str) -> str:
    """The text of a row's cell of class line: one walk over its tags, silent inside pop-ups."""
    out, at, inside, popup, depth = [], 0, False, "", 0
    for m in _TAG.finditer(row):
        if inside and not depth:
            out.append(row[at : m.start()])
        at, tag = m.end(), m[2].lower()
        if depth:
            depth += 0 if tag != popup else -1 if m[1] else 1
        elif not m[1]:
            classes = set(_attributes(m[3]).get("class", "").split())
            inside = inside or (tag == "td" and "line" in classes)
            if inside and classes & POPUPS:
                popup, depth = tag, 1
    if inside and not depth:
        out.append(row[at:])
    return entities.unescape("".join(out)).rstrip()


def metadata(content: Column) -> Column:
    """struct of the comment block's values; numbers are 0 and texts empty where they are missing."""
    one = lambda key: F.regexp_extract(content, rf"<!--\s*{METADATA[key]}\s+(.+?)\s*-->", 1)
    number = lambda key: F.coalesce(F.regexp_extract(content, rf"<!--\s*{METADATA[key]}\s+(\d+)\s*-->", 1).try_cast("int"), F.lit(0))
    return F.struct(*[(number(k) if k in ("bug_line", "bug_column", "path_length") else one(k)).alias(k) for k in METADATA])


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """One row per report: path, content and its metadata."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))
    return raw.withColumn("m", metadata(F.col("content"))).select("path", "content", "m.*")


def _rows(schema: str, names: list[tuple[str, pa.DataType]], scan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, *r) for p, c, f in zip(b["path"].to_pylist(), b["content"].to_pylist(), b["bug_file"].to_pylist()) for r in scan(c or "", f or "")]
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, names)], names=[n for n, _ in names])

    return run


def events(reports: DataFrame) -> DataFrame:
    """Raw event rows: path, step (from 1), path_number, event_type, text, file, line."""
    names = [("path", pa.string()), ("step", pa.int32()), ("path_number", pa.int32()), ("event_type", pa.string()), ("text", pa.string()), ("file", pa.string()), ("line", pa.int32())]
    scan = lambda c, f: [(i + 1, e["path_number"], e["event_type"], e["text"], e["file"], e["line"]) for i, e in enumerate(scan_events(c, f))]
    return reports.select("path", "content", "bug_file").mapInArrow(_rows("", names, scan), "path string, step int, path_number int, event_type string, text string, file string, line int")


def embedded_lines(reports: DataFrame) -> DataFrame:
    """path, file, line, text of the listings in the reports."""
    names = [("path", pa.string()), ("file", pa.string()), ("line", pa.int32()), ("text", pa.string())]
    return reports.select("path", "content", "bug_file").mapInArrow(_rows("", names, scan_lines), "path string, file string, line int, text string")


def classify(raw: DataFrame) -> DataFrame:
    """Adds kind, direction (null where the report names none), callee, assumption.

    In order: error start, call, end of path, control markup, return, assumption, report, plain event."""
    # what a box says, without the arrows around it; as words for what it says of a direction
    said = F.regexp_replace("text", r"^[^\w']+|[^\w'\")\].]+$", "")
    words = F.concat(F.lit(" "), F.array_join(F.filter(F.split(F.lower(said), r"[^a-z]+"), lambda w: w != ""), " "), F.lit(" "))
    says = lambda word: words.contains(f" {word} branch ") | words.contains(f" condition is {word} ")
    direction = F.when(says("true"), True).when(says("false"), False)
    after = lambda start: F.when(said.contains(start), F.substring_index(said, start, -1))
    callee = F.coalesce(F.when(said.contains("Calling '"), F.substring_index(after("Calling '"), "'", 1)), F.lit(""))
    returning = F.coalesce(F.translate(after("Returning from "), "'", ""), F.lit(""))
    assumed = F.when(F.lower(said).startswith("assuming "), said).otherwise("")
    kind = (
        F.when(F.lower("text").contains("error start"), "error_start").when(callee != "", "call").when(F.col("path_number") == END_OF_PATH, "report")
        .when(F.col("event_type") == "control", "control").when(returning != "", "return").when(assumed != "", "assume").when(F.col("event_type") == "report", "report").otherwise("event")
    )
    typed = raw.withColumn("kind", kind)
    return typed.withColumns({
        "direction": F.when(F.col("kind").isin("control", "assume"), direction),
        "callee": F.when(F.col("kind") == "call", callee).when(F.col("kind") == "return", F.trim(returning)).otherwise(""),
        "assumption": F.when(F.col("kind") == "assume", F.trim(assumed)).otherwise(""),
    })
