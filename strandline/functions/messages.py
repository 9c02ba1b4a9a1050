"""What an analyzer's message says, read word by word into fields: one reader for all that look at messages.

A message is cut at its quotes once: pieces at odd places are quoted names, the others are plain words. What it assumes,
stores or loads follows from the words around them; a message that isn't of these kinds reads as nulls.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions import constraints as C

# Words that stand before a name without naming anything, and how relations and states are worded.
FILLERS = ("field", "variable", "memory", "the", "pointer", "value")
RELATIONS = ("==", "!=", "<=", ">=", "<", ">")
STATES = {"null": ("==", "null"), "non-null": ("!=", "null"), "true": ("==", "true"), "false": ("==", "false")}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it; plain columns would be spelled out at each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text between white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def _unquoted(word: Column) -> Column:
    return F.regexp_replace(F.trim(F.translate(word, "'\"", "  ")), r"[.,;)]+$", "")


def _only_fillers(found: Column) -> Column:
    return F.forall(found, lambda w: F.lower(w).isin(*FILLERS))


def after(message: Column, phrase: str) -> Column:
    """What follows the first occurrence of a phrase, whatever its case; null without one."""
    at = F.locate(phrase, F.lower(message))
    return F.when(at > 0, F.substring(message, at + len(phrase), F.length(message)))


def named_after(message: Column, *phrases: str) -> Column:
    """The quoted name that one of the phrases introduces, fillers between them allowed; null without one."""
    named = lambda q: F.when((F.size(q) > 2) & _only_fillers(words(F.get(q, F.lit(0)))), F.nullif(F.get(q, F.lit(1)), F.lit("")))
    return F.coalesce(*[let(F.split(after(message, phrase), "['\"]"), named) for phrase in phrases])


def _claim(subject: Column, said: Column) -> Column:
    """The struct of a subject and the words from `is` on."""
    word = lambda i: F.lower(F.get(said, F.lit(i)))
    left = lambda i: F.filter(F.slice(said, F.lit(i + 1), F.greatest(F.size(said), F.lit(1))), lambda w: ~F.lower(w).isin(*FILLERS))
    value = lambda i: _unquoted(F.get(left(i), F.lit(0)))
    made = lambda op, v: F.struct(subject.alias("subject"), op.alias("operator"), v.alias("value"))
    told = F.when((word(1) == "not") & (word(2) == "equal") & (word(3) == "to"), made(F.lit("!="), value(4))).when((word(1) == "equal") & (word(2) == "to"), made(F.lit("=="), value(3)))
    told = told.when(word(1).isin(*RELATIONS), made(F.get(said, F.lit(1)), value(2)))
    for state, (op, v) in STATES.items():
        told = told.when(_unquoted(word(1)) == state, made(F.lit(op), F.lit(v)))
    return let(F.when((word(0) == "is") & (subject != ""), told), lambda t: F.when(t["value"] != "", t))


def assumed(message: Column) -> Column:
    """struct(subject, operator, value) of a message that assumes something; null for others and for relations that aren't known.

    The subject is the quoted name, or the words before `is` without field and the: `condition`, `pointer value`, a bare name."""

    def parts(rest: Column, quoted: Column, plain: Column) -> Column:
        named = (F.size(quoted) > 2) & _only_fillers(words(F.get(quoted, F.lit(0))))
        at = F.array_position(F.transform(plain, F.lower), "is").cast("int")
        before = F.filter(F.slice(plain, F.lit(1), F.greatest(at - 1, F.lit(0))), lambda w: ~F.lower(w).isin("field", "the"))
        behind = words(F.array_join(F.slice(quoted, F.lit(3), F.greatest(F.size(quoted), F.lit(1))), "'"))
        return F.struct(F.when(named, F.get(quoted, F.lit(1))).when(at > 0, F.array_join(before, " ")).alias("subject"), F.when(named, behind).when(at > 0, F.slice(plain, at, F.size(plain))).alias("said"))

    begins = F.startswith(F.lower(F.trim(message)), F.lit("assuming "))
    rest = F.when(begins, F.substring(F.trim(message), 10, F.length(message)))
    cut = let(rest, lambda r: let(F.split(r, "'"), lambda q: let(words(r), lambda w: parts(r, q, w))))
    return F.when(begins, let(cut, lambda c: _claim(c["subject"], c["said"])))


def assumes_null_pointer(message: Column) -> Column:
    """Whether a message assumes that an unnamed pointer is null."""
    null = lambda given: (given["subject"] == "pointer value") & (given["operator"] == "==") & (given["value"] == "null")
    return F.coalesce(let(assumed(message), null), F.lit(False))


def stored(message: Column) -> Column:
    """struct(subject, value) of a message that stores something to a quoted name; value is null for a null pointer; null for others."""

    def value(before: Column) -> Column:
        null = F.endswith(F.lower(F.array_join(before, " ")), F.lit("null pointer value"))
        return F.when(null, "null").when(F.lower(F.try_element_at(before, F.lit(-2))) == "value", _unquoted(F.try_element_at(before, F.lit(-1))))

    at = F.greatest(F.locate("stored to ", F.lower(message)), F.locate("assigned to ", F.lower(message)))
    before = F.filter(words(F.substring(message, F.lit(1), at - 1)), lambda w: F.lower(w) != "is")
    both = F.struct(named_after(message, "stored to ", "assigned to ").alias("subject"), let(before, value).alias("value"))
    return let(both, lambda b: F.when(b["subject"].isNotNull() & b["value"].isNotNull(), b))


def loaded(message: Column) -> Column:
    """The quoted variable that a value was loaded or read from; null for other messages."""
    return named_after(message, "loaded from ", "read from ")


_NAME = r"^[A-Za-z_][\w.>\-\[\]]*$"


def comparison(term: Column) -> Column:
    """struct(subject, operator, value) of one comparison of a name with a literal, or of a bare or negated name (not zero,
    zero); null for anything else."""
    made = lambda subject, op, v: F.struct(subject.alias("subject"), op.alias("operator"), v.alias("value"))

    def sides(op: str, bare: Column) -> Column:
        return F.split(bare, op, -1)

    def of(bare: Column) -> Column:
        name, inner = F.when(bare.rlike(_NAME), bare), F.trim(F.substring(bare, 2, F.length(bare)))
        claim = F.when(name.isNotNull(), made(name, F.lit("!="), F.lit("0"))).when(F.startswith(bare, F.lit("!")) & inner.rlike(_NAME), made(inner, F.lit("=="), F.lit("0")))
        for op in RELATIONS:  # two characters first
            pair = lambda i, op=op: F.trim(F.get(sides(op, bare), F.lit(i)))
            claim = claim.when((F.size(sides(op, bare)) == 2) & pair(0).rlike(_NAME.replace(">", "")) & pair(1).rlike(r"^[+-]?\w+$"), made(pair(0), F.lit(op), pair(1)))
        return claim

    return let(F.trim(term), of)


def _number(value: Column) -> Column:
    return F.when(F.lower(value) == "false", F.lit(0.0)).otherwise(C.to_number(value))


def refutes(given: Column, need: Column) -> Column:
    """Whether what is given (subject, operator, value) and what is needed can't both hold; false where that isn't plain.

    true as a value means not zero, false and null words mean zero."""

    def of(both: Column) -> Column:
        said, asked = both["said"], both["asked"]
        true = F.lower(said["value"]) == "true"
        numbers = F.struct(
            F.when(true & (said["operator"] == "=="), "!=").otherwise(said["operator"]).alias("p"), F.when(true, F.lit(0.0)).otherwise(_number(said["value"])).alias("a"),
            asked["operator"].alias("q"), _number(asked["value"]).alias("b"),
        )
        return (said["subject"] == asked["subject"]) & let(numbers, lambda n: ~C.ranges_intersect(n["p"], n["a"], n["q"], n["b"]))

    return F.coalesce(let(F.struct(given.alias("said"), need.alias("asked")), of), F.lit(False))


def negated(need: Column) -> Column:
    """The opposite comparison."""
    return let(need, lambda n: F.when(n.isNotNull(), F.struct(n["subject"].alias("subject"), C.negate(n["operator"]).alias("operator"), n["value"].alias("value"))))


def refuted(condition: Column, given: Column) -> Column:
    """Whether a condition can't hold under what is given: each of its alternatives has a part that can't. Parts in brackets
    are taken for possible, and brackets that a cut at || or && opens make no claim."""
    none = lambda g: F.forall(F.split(condition, r"\|\|"), lambda a: F.exists(F.split(a, "&&"), lambda part: refutes(g, comparison(part))))
    return F.coalesce(let(given, none), F.lit(False))
