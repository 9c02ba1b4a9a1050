"""Text operators: conditions, identifiers, literals and source lines as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are no variables.
KEYWORDS = ("if", "while", "for", "return", "sizeof", "true", "false", "null", "NULL", "nullptr", "const", "static_cast", "int", "bool", "char")


def identifiers(expr: Column) -> Column:
    """Identifiers of an expression, member chains whole, keywords left out, in order of first sight."""
    found = F.regexp_extract_all(expr, F.lit(r"[A-Za-z_]\w*+(?:(?:->|\.)[A-Za-z_]\w*+)*+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda x: ~x.isin(*KEYWORDS)))


def strip_comment(line: Column) -> Column:
    """The line without its string literals' content and without a trailing comment."""
    return F.rtrim(F.regexp_replace(F.regexp_replace(line, r'"(?:[^"\\]++|\\.)*+"', '""'), r"//.*$", ""))


def strip_tags(text: Column) -> Column:
    """Markup stripped, the common character references decoded, white space collapsed."""
    bare = F.regexp_replace(text, r"<[^>]*>", "")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def fold_four(text: Column) -> Column:
    """The first four ASCII characters as a little-endian whole number, null if there are fewer."""
    value = None
    for i in range(4):
        part = F.call_function("shiftleft", F.ascii(F.substring(text, i + 1, 1)).cast("long"), F.lit(8 * i))
        value = part if value is None else value.bitwiseOR(part)
    return F.when(text.rlike(r"^[\x00-\x7F]{4}"), value)


def equality_leaf(expr: Column) -> Column:
    """struct(variable, constant) of 'name == literal' or 'literal == name', the literal a number or an UPPER_CASE name; else null."""
    left = r"^\s*\(*\s*([A-Za-z_][\w.]*(?:->\w+)*+)\s*==\s*(-?\d\w*|[A-Z][A-Z0-9_]+|'[^']{1,4}')\s*\)*\s*$"
    right = r"^\s*\(*\s*(-?\d\w*|[A-Z][A-Z0-9_]+|'[^']{1,4}')\s*==\s*([A-Za-z_][\w.]*(?:->\w+)*+)\s*\)*\s*$"
    a = F.struct(F.regexp_extract(expr, left, 1).alias("variable"), F.regexp_extract(expr, left, 2).alias("constant"))
    b = F.struct(F.regexp_extract(expr, right, 2).alias("variable"), F.regexp_extract(expr, right, 1).alias("constant"))
    return F.when(expr.rlike(left), a).when(expr.rlike(right), b)


def short_name(name: Column) -> Column:
    """The last component of a qualified name, template arguments dropped."""
    return F.element_at(F.split(F.regexp_replace(name, r"<[^<>]*>", ""), "::"), -1)


def normal_call_edge(node_id: Column) -> Column:
    """A call edge's id without its call line: call sites of one callee become one."""
    return F.regexp_replace(node_id, r"_L\d+(?=_|$)", "")


def artifact_key(name: Column, most: int = 80) -> Column:
    """A name made safe for files, cut at so many characters."""
    return F.substring(F.regexp_replace(name, r"[^\w.-]", "_"), 1, most)
