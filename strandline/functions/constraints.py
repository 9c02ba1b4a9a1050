"""Constraint algebra as column expressions: normal forms, negation, and when two constraints clash.

Three notions of a clash are kept apart, as they differ on purpose: closed intervals with a small margin, ranges with a
tolerance, and pairs of whole numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Operators and their opposites.
NEGATED = {"==": "!=", "!=": "==", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}
NULL_WORDS = ("null", "nullptr", "NULL")


def negate(op: Column) -> Column:
    """The opposite comparison, null for an unknown operator."""
    out = None
    for a, b in NEGATED.items():
        out = F.when(op == a, b) if out is None else out.when(op == a, b)
    return out


def same_text(a: Column, b: Column) -> Column:
    """Whether two conditions are the same but for white space."""
    return F.regexp_replace(a, r"\s+", "") == F.regexp_replace(b, r"\s+", "")


def to_number(text: Column) -> Column:
    """A decimal or hexadecimal literal (suffixes u, l, f dropped) as a double; null for anything else, null words being 0."""
    t = F.trim(text)
    bare = F.regexp_replace(t, r"(?i)(?<=\d)[ulf]+$", "")
    hexa = F.regexp_extract(t, r"^0[xX]([0-9a-fA-F]+)[uUlL]*$", 1)
    return (
        F.when(t.isin(*NULL_WORDS), F.lit(0.0))
        .when(hexa != "", F.conv(hexa, 16, 10).cast("double"))
        .when(bare.rlike(r"^[+-]?\d+(\.\d*)?([eE][+-]?\d+)?$"), bare.cast("double"))
    )


def _low(op: Column, value: Column, margin: Column) -> Column:
    return F.when(op.isin("==", ">="), value).when(op == ">", value + margin).otherwise(F.lit(float("-inf")))


def _high(op: Column, value: Column, margin: Column) -> Column:
    return F.when(op.isin("==", "<="), value).when(op == "<", value - margin).otherwise(F.lit(float("inf")))


def intervals_clash(op_a: Column, a: Column, op_b: Column, b: Column) -> Column:
    """Whether no number satisfies both; strict bounds become closed with a margin of 1e-9 of the value (1e-9 at 0)."""
    margin = lambda v: F.when(v == 0, F.lit(1e-9)).otherwise(F.abs(v) * 1e-9)
    apart = F.greatest(_low(op_a, a, margin(a)), _low(op_b, b, margin(b))) > F.least(_high(op_a, a, margin(a)), _high(op_b, b, margin(b)))
    never = ((op_a == "!=") & (op_b == "==") | (op_a == "==") & (op_b == "!=")) & (a == b)
    return apart | never


def ranges_intersect(op_a: Column, a: Column, op_b: Column, b: Column, tolerance: float = 1e-9) -> Column:
    """Whether two ranges share a number, equal within the tolerance counting as equal; '!=' excludes only an equal point."""
    near = F.abs(a - b) <= tolerance
    up = lambda op: op.isin(">", ">=")
    down = lambda op: op.isin("<", "<=")
    meets = lambda lo, x, hi, y: F.when(F.abs(x - y) <= tolerance, (lo == ">=") & (hi == "<=")).otherwise(x < y)
    point = lambda v, op, w: F.when(op == ">", (v > w) & ~near).when(op == ">=", (v > w) | near).when(op == "<", (v < w) & ~near).when(op == "<=", (v < w) | near).when(op == "!=", ~near).otherwise(near)
    return (
        F.when(op_a == "==", point(a, op_b, b)).when(op_b == "==", point(b, op_a, a))
        .when((op_a == "!=") | (op_b == "!="), True)
        .when(up(op_a) & down(op_b), meets(op_a, a, op_b, b)).when(down(op_a) & up(op_b), meets(op_b, b, op_a, a))
        .otherwise(True)
    )


def integers_clash(op_a: Column, a: Column, op_b: Column, b: Column) -> Column:
    """The narrow notion for learned patterns: == against ==, != or a strict bound, and opposite bounds; '==' against '>=' or '<=' never clashes."""
    one = lambda p, x, q, y: (
        F.when((p == "==") & (q == "=="), x != y).when((p == "==") & (q == "!="), x == y).when((p == "==") & (q == ">"), x <= y).when((p == "==") & (q == "<"), x >= y)
        .when((p == ">=") & (q == "<"), x >= y).when((p == ">") & (q == "<"), x >= y - 1).when((p == ">") & (q == "<="), x >= y).when((p == ">=") & (q == "<="), x > y)
    )
    return F.coalesce(one(op_a, a, op_b, b), one(op_b, b, op_a, a), F.lit(False))


def satisfies(value: Column, op: Column, bound: Column) -> Column:
    """Whether a returned constant meets a postcondition; unknown values or operators count as met, so that nothing is refuted by ignorance."""
    v, b = to_number(value), to_number(bound)
    test = F.when(op == "==", v == b).when(op == "!=", v != b).when(op == "<", v < b).when(op == "<=", v <= b).when(op == ">", v > b).when(op == ">=", v >= b)
    text = F.when(op == "==", value == bound).when(op == "!=", value != bound)
    return F.coalesce(F.when(v.isNotNull() & b.isNotNull(), test).otherwise(text), F.lit(True))


def parse_constraint(text: Column) -> Column:
    """struct(variable, operator, value) of the first comparison in a text; null if there is none."""
    pattern = r"([A-Za-z_][\w.\->\[\]]*)\s*(==|!=|<=|>=|<|>)\s*(-?[\w.]+)"
    part = lambda i: F.regexp_extract(text, pattern, i)
    return F.when(part(2) != "", F.struct(part(1).alias("variable"), part(2).alias("operator"), part(3).alias("value")))


def requires_non_null(condition: Column, variable: Column) -> Column:
    """Whether a condition holds only while a pointer isn't null, in a form that shows it: V, !!V, V != null or null != V, in
    brackets or not. Everything else, the opposite and compound conditions included, is false."""
    bare = F.regexp_replace(F.regexp_replace(condition, r"\b(?:nullptr|NULL|__null)\b", "0"), r"\s+", "")
    part = lambda i: F.regexp_extract(bare, r"^(\(*)((?:!!)*+)(?:([A-Za-z_]\w*)(?:!=0)?|0!=([A-Za-z_]\w*))(\)*)$", i)
    return F.coalesce((F.concat(part(3), part(4)) == variable) & (F.length(part(1)) == F.length(part(5))), F.lit(False))


def is_pointer_parameter(parameters: Column, variable: Column) -> Column:
    """Whether a parameter list declares the variable as a pointer; function pointers never count."""
    own = F.filter(F.split(parameters, ","), lambda p: ~p.rlike(r"[()]") & (F.regexp_extract(p, r"([A-Za-z_]\w*)[^A-Za-z_]*$", 1) == variable))
    return F.coalesce(F.exists(own, lambda p: p.contains("*")), F.lit(False))
