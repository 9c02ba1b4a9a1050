"""Control structure of source text, and what a path says about it: implicit false branches, short circuits and dead ranges.

A file's brackets are matched once, in Arrow batches of whole files, into rows of control statements and functions. What a
path means for them is then a matter of joins and windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import messages as M

_TOKEN = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|#[^\n]*|[A-Za-z_]\w*|\|\||&&|::|->|\n|[(){}\[\];:,]|[^\s\w]|\d[\w.]*", re.S)
_PAIRS = {")": "(", "}": "{", "]": "["}
CONTROL = ("if", "while", "for", "switch")
_NO_FUNCTION = frozenset((*CONTROL, "return", "sizeof", "catch", "else", "do", "case", "new", "delete", "throw", "defined", "alignof", "decltype"))


def _scan(source: str) -> tuple[list[tuple[str, int, int]], dict[int, int]]:
    """Tokens (text, line, place) without comments and preprocessor lines, and the number of each opening bracket's partner."""
    tokens, partner, open_, line = [], {}, [], 1
    for m in _TOKEN.finditer(source):
        t = m[0]
        if t == "\n":
            line += 1
            continue
        if t.startswith(("//", "/*")) or (t[0] == "#" and not source[source.rfind("\n", 0, m.start()) + 1 : m.start()].strip()):
            line += t.count("\n")
            continue
        i = len(tokens)
        tokens.append((t, line, m.start()))
        if t in "({[":
            open_.append(i)
        elif t in _PAIRS and open_ and tokens[open_[-1]][0] == _PAIRS[t]:
            partner[open_.pop()] = i
        line += t.count("\n")
    return tokens, partner


def _end_of_statement(tokens, partner, i: int) -> int | None:
    """The number of a statement's last token, for a body that may lack braces."""
    n = len(tokens)
    while i < n:
        t = tokens[i][0]
        if t == "{":
            return partner.get(i)
        if t in CONTROL and i + 1 < n and tokens[i + 1][0] == "(":
            close = partner.get(i + 1)
            end = _end_of_statement(tokens, partner, close + 1) if close is not None else None
            if end is not None and t == "if" and end + 1 < n and tokens[end + 1][0] == "else":
                return _end_of_statement(tokens, partner, end + 2)
            return end
        j = i
        while j < n and tokens[j][0] not in ";}":
            j = partner.get(j, j) + 1 if tokens[j][0] in "({[" else j + 1
        return j if j < n and tokens[j][0] == ";" else None
    return None


def scan_controls(source: str) -> list[tuple[int, str, str, int, int, list[dict], list[dict]]]:
    """(line, keyword, condition, body_start, body_end, else_ranges, operands) of every control statement that is complete."""
    tokens, partner = _scan(source)
    out = []
    for i, (t, line, _) in enumerate(tokens[:-1]):
        if t not in CONTROL or tokens[i + 1][0] != "(" or (close := partner.get(i + 1)) is None or close + 1 >= len(tokens):
            continue
        try:
            end = _end_of_statement(tokens, partner, close + 1)
        except RecursionError:
            end = None
        if end is None:
            continue
        chain, at = [], end
        while t == "if" and at + 1 < len(tokens) and tokens[at + 1][0] == "else":
            word, start = at + 1, at + 2
            if start < len(tokens) and tokens[start][0] == "if" and (inner := partner.get(start + 1)) is not None:
                start = inner + 1
            at = _end_of_statement(tokens, partner, start)
            if at is None:
                break
            chain.append({"low": tokens[word][1], "high": tokens[at][1]})
        operands, depth, before = [], 0, ""
        for text, where, _ in tokens[i + 2 : close]:
            depth += (text in "([{") - (text in ")]}")
            if not depth and text in ("||", "&&"):
                before = text
            elif before or not operands:
                operands.append({"line": where, "joined_by": before})
                before = ""
        condition = re.sub(r"\s+", " ", re.sub(r"//[^\n]*|/\*.*?\*/", " ", source[tokens[i + 1][2] + 1 : tokens[close][2]], flags=re.S)).strip()
        out.append((line, t, condition, tokens[close + 1][1], tokens[end][1], chain, operands))
    return out


def _functions(tokens, partner) -> list[tuple[str, int, int, int]]:
    """(name, first token, token that opens the body, token that closes it) of every function that has a body."""
    out, inside = [], -1
    for i, (t, line, _) in enumerate(tokens):
        if i <= inside or t != "(" or not i or (close := partner.get(i)) is None:
            continue
        name = tokens[i - 1][0]
        if not re.match(r"[A-Za-z_]", name) or name in _NO_FUNCTION:
            continue
        j = close + 1
        while j < len(tokens) and (re.match(r"(?:const|noexcept|override|final|->|[A-Za-z_]\w*|&|\*|<|>|::)$", tokens[j][0]) or tokens[j][0] in ":,("):
            j = partner.get(j, j) + 1 if tokens[j][0] == "(" else j + 1
        if j >= len(tokens) or tokens[j][0] != "{" or (end := partner.get(j)) is None:
            continue
        k = i - 1
        while k >= 2 and tokens[k - 1][0] in ("::", "~"):
            step = 2 if tokens[k - 1][0] == "::" else 1
            name = "".join(x[0] for x in tokens[k - step : k]) + name
            k -= step
        out.append((name, k, j, end))
        inside = end
    return out


def scan_functions(source: str) -> list[tuple[str, int, int, int]]:
    """(name, first line, first line of the body, last line) of every function that has a body."""
    tokens, partner = _scan(source)
    return [(name, *(tokens[i][1] for i in places)) for name, *places in _functions(tokens, partner)]


def scan_returns(source: str) -> list[tuple[str, str, int, bool]]:
    """(function, owner, line, value) of the first 'return true' or 'return false' directly in an if's body (owner branch,
    the if's line) or in a function's (owner function, its last line)."""
    tokens, partner = _scan(source)
    closing, out = set(partner.values()), []
    owners = {i + 2 if (close := partner.get(i + 1)) is None else close + 1: ("branch", tokens[i][1]) for i in range(len(tokens) - 1) if tokens[i][0] == "if" and tokens[i + 1][0] == "("}
    for name, _, start, end in _functions(tokens, partner):
        owners[start] = ("function", tokens[end][1])
        given, around = set(), []
        for i in range(start, end + 1):
            t = tokens[i][0]
            if t == "{" and i in partner:
                around.append(owners.get(i))
            elif t == "}" and i in closing:
                around.pop()
            elif t == "return" and i + 2 < end and tokens[i + 1][0] in ("true", "false") and tokens[i + 2][0] == ";":
                owner = owners.get(i) or around[-1]
                if owner and owner not in given:
                    given.add(owner)
                    out.append((name, *owner, tokens[i + 1][0] == "true"))
    return out


_SPANS = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
_OPERANDS = pa.list_(pa.struct([("line", pa.int32()), ("joined_by", pa.string())]))


def _per_file(scan, names: list[tuple[str, pa.DataType]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(f, *r) for f, c in zip(b["file"].to_pylist(), b["content"].to_pylist()) for r in scan(c or "")]
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, names)], names=[n for n, _ in names])

    return run


def control_statements(files: DataFrame) -> DataFrame:
    """files (file, content) as one row per control statement: file, line, keyword, condition, body_start, body_end, else_ranges, operands.

    A body without braces is one statement; statements whose brackets don't close are left out."""
    names = [("file", pa.string()), ("line", pa.int32()), ("keyword", pa.string()), ("condition", pa.string()), ("body_start", pa.int32()), ("body_end", pa.int32()), ("else_ranges", _SPANS), ("operands", _OPERANDS)]
    schema = "file string, line int, keyword string, condition string, body_start int, body_end int, else_ranges array<struct<low int, high int>>, operands array<struct<line int, joined_by string>>"
    return files.select("file", "content").mapInArrow(_per_file(scan_controls, names), schema)


def function_ranges(files: DataFrame) -> DataFrame:
    """files (file, content) as one row per function with a body: file, function_name, first_line, body_start, last_line."""
    names = [("file", pa.string()), ("function_name", pa.string()), ("first_line", pa.int32()), ("body_start", pa.int32()), ("last_line", pa.int32())]
    return files.select("file", "content").mapInArrow(_per_file(scan_functions, names), "file string, function_name string, first_line int, body_start int, last_line int")


def truth_returns(files: DataFrame) -> DataFrame:
    """files (file, content) as one row per branch or function that itself returns a truth value: file, function, owner (branch or function), line, returned."""
    names = [("file", pa.string()), ("function", pa.string()), ("owner", pa.string()), ("line", pa.int32()), ("returned", pa.bool_())]
    return files.select("file", "content").mapInArrow(_per_file(scan_returns, names), "file string, function string, owner string, line int, returned boolean")


def falsified(condition: Column, assumption: Column) -> Column:
    """Whether an assumption's message refutes a condition's text; false where it doesn't plainly."""
    given = M.assumed(assumption)
    itself = F.coalesce((given["subject"] == "condition") & (given["operator"] == "==") & (given["value"] == "false"), F.lit(False))
    return itself | M.refuted(condition, given)


def implicit_false(events: DataFrame, controls: DataFrame, key: str = "report_key") -> DataFrame:
    """Control statements that a path proves false without saying so: key, file, line, step of the first such assumption.

    events: key, step, kind, file, line, message. An assumption stands at the statement's line, no control event does, and
    either its text refutes the condition or the first later event at or after the body lies beyond it."""
    stated = events.where("kind = 'control'").select(key, "file", "line").distinct()
    assumed = events.where("kind IN ('event', 'assume')").where(F.lower("message").contains("assuming")).join(stated, [key, "file", "line"], "left_anti")
    joined = assumed.join(controls.select("file", "line", "condition", "body_start", "body_end"), ["file", "line"])
    # the first later event at or after the body: a join inside the report, folded to one row per assumption and statement
    after = events.where("line > 0").select(key, F.col("step").alias("_s"), F.col("line").alias("_l"))
    met = (F.col("_s") > F.col("step")) & (F.col("_l") >= F.col("body_start"))
    at = [key, "file", "line", "step", "condition", "message", "body_start", "body_end"]
    held = joined.select(*at).join(after, key, "left").groupBy(*at).agg(F.min(F.when(met, F.struct("_s", "_l")))["_l"].alias("_following"))
    proved = falsified(F.col("condition"), F.col("message")) | F.coalesce(F.col("_following") > F.col("body_end"), F.lit(False))
    return held.where(proved).groupBy(key, "file", "line").agg(F.min("step").alias("step"))


def short_circuits(events: DataFrame, controls: DataFrame, key: str = "report_key") -> DataFrame:
    """Operands that are never evaluated as the first one decided: key, file, line, reason.

    A chain of || is decided by a first operand that an assumption on its line makes true, one of && by one that it makes
    false; both are told by comparing what is assumed with the operand's text. Operands that aren't a comparison of a name
    with a literal, or a name alone, decide nothing, nor do chains that mix both operators. Operands on the deciding line
    itself can't be told apart and don't count."""
    said = events.select(key, "file", F.col("line").alias("_at"), M.assumed(F.col("message")).alias("_given")).where("_given IS NOT NULL")
    joins = F.array_distinct(F.transform(F.slice("operands", F.lit(2), F.greatest(F.size("operands"), F.lit(1))), lambda o: o["joined_by"]))
    chains = controls.where(F.size("operands") > 1).select("file", F.get(F.col("operands"), F.lit(0))["line"].alias("_at"), "operands", joins.alias("_by"), "condition").where(F.size("_by") == 1)
    chains = chains.withColumn("_by", F.get("_by", F.lit(0)))
    first = M.comparison(F.get(F.when(F.col("_by") == "||", F.split("condition", r"\|\|")).otherwise(F.split("condition", "&&")), F.lit(0)))
    hit = said.join(chains, ["file", "_at"]).withColumn("_need", first)
    true, false = M.refutes(F.col("_given"), M.negated(F.col("_need"))), M.refutes(F.col("_given"), F.col("_need"))
    hit = hit.where(((F.col("_by") == "||") & true) | ((F.col("_by") == "&&") & false)).select(key, "file", "_at", "_by", F.explode(F.slice("operands", F.lit(2), F.size("operands"))).alias("o"))
    return hit.where(F.col("o.line") > F.col("_at")).select(key, "file", F.col("o.line").alias("line"), F.when(F.col("_by") == "||", "first operand is true").otherwise("first operand is false").alias("reason")).distinct()


def dead_ranges(decided: DataFrame, controls: DataFrame, key: str = "report_key") -> DataFrame:
    """Line ranges that a path's decisions rule out: key, file, low, high. decided: key, file, line, taken.

    A false branch rules out its body, a true one every else clause of its chain."""
    joined = decided.where("taken IS NOT NULL").join(controls, ["file", "line"])
    body = joined.where("NOT taken").select(key, "file", F.col("body_start").alias("low"), F.col("body_end").alias("high"))
    other = joined.where("taken AND keyword = 'if'").select(key, "file", F.explode("else_ranges").alias("r")).select(key, "file", "r.low", "r.high")
    return body.unionByName(other).distinct()
