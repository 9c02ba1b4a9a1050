"""Conditions of dumped control flow in source form: references to elements are rewritten round by round over a table.

A dump spells an expression out as numbered elements: `[B6.15]` names the fifteenth of block B6, an element refers to
others, and a cast or a member access leaves its operand to the element before it. First every element becomes a rule that
names all its operands. Then all rules are rewritten together: in each round a reference is replaced by what the round
before made of it, so an element that many share is resolved once, and after ROUNDS rounds what is left, as in a cycle,
stays a reference. Short functions are grouped, and their rounds run where they are; only long ones take rounds over tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.operators.graph import HELD_ROWS, discard, settle

#: Levels of references that are followed.
ROUNDS = 10
#: A term of more characters stays a reference in what refers to it.
MOST_CHARACTERS = 10_000
#: How a dump writes an element's number and a kind of syntax node, and the terminators that test something.
REFERENCE = r"\[\w+\.\d+\]"
NODE_KIND = r"^\([A-Z]\w*(?:,[^()\[\]]*)?\)"
TESTING = ("if", "while", "for")
COMPARISONS = ("==", "!=", ">=", "<=", ">", "<")


def _unlabelled(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"^\s*\[\w+\.\d+\]", ""))


def _bare(text: Column) -> Column:
    """The text without the kind of syntax node before it."""
    return F.trim(F.regexp_replace(text, NODE_KIND, ""))


def rules(statements: DataFrame) -> DataFrame:
    """function, block, key, ordinal, rule, before: each element with its operands named, and the element before it; key is `block.number`.

    statements: function, block, ordinal, text. A line that begins with `[block.number]` is an element, any other is a bare
    value. A cast alone stands for its input and a member access goes on from it: the bare value between the element
    before and this one, else that element, else the nearest bare value above. Casts and address-taking lines are no bare
    values. An element without an input is its own text."""
    text = F.trim(F.coalesce("text", F.lit("")))
    label = F.regexp_extract("line", r"^\[(\w+\.\d+)\]", 1)
    lines = statements.select("function", "block", "ordinal", text.alias("line")).withColumn("key", F.when(F.startswith(label, F.concat("block", F.lit("."))), label))
    labelled, free = F.col("key").isNotNull(), F.col("line").rlike(r"^[^\[(&]")
    above = Window.partitionBy("function", "block").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumns({
        "_e": F.last(F.when(labelled, F.struct("ordinal", "key")), ignorenulls=True).over(above),
        "_v": F.last(F.when(~labelled & free, F.struct("ordinal", "line")), ignorenulls=True).over(above),
    }).where(labelled)
    reference = F.concat(F.lit("["), F.col("_e.key"), F.lit("]"))
    source = F.when(F.col("_e").isNull() | (F.col("_v.ordinal") > F.col("_e.ordinal")), F.col("_v.line")).otherwise(reference)
    body = _bare(_unlabelled(F.col("line")))
    member = F.startswith(body, F.lit("->")) | F.startswith(body, F.lit("."))
    rule = F.when(body == "", source).when(member, F.concat(F.coalesce(source, F.lit("")), body)).otherwise(body)
    return lines.select("function", "block", "key", "ordinal", rule.alias("rule"), F.when(F.col("_e").isNotNull(), reference).alias("before"))


def bare_values(statements: DataFrame) -> DataFrame:
    """function, block, value: the last bare value of each block, which stands for elements that the block doesn't list."""
    text = F.trim(F.coalesce("text", F.lit("")))
    return statements.where(text.rlike(r"^[^\[(]")).groupBy("function", "block").agg(F.max_by(text, "ordinal").alias("value"))


def references(text: Column) -> Column:
    """The keys that a text refers to, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), lambda r: F.substring(r, 2, 1 << 20).substr(F.lit(1), F.length(r) - 2))


def substituted(text: Column, values: Column) -> Column:
    """The text with its references replaced by the values, one for each, in order."""
    between = F.split(text, REFERENCE, -1)
    return F.array_join(F.zip_with(between, values, lambda t, v: F.concat(t, F.coalesce(v, F.lit("")))), "")


def _rewritten(asked: DataFrame, keys: list[str], term: str, known: DataFrame, extra: DataFrame | None) -> DataFrame:
    """keys, text, final: the terms with their references replaced by known texts; final if nothing can change any more."""
    refs = asked.select("function", *keys, F.col(term).alias("_term"), F.posexplode_outer(references(F.col(term))).alias("pos", "ref"))
    met = refs.join(known.select("function", F.col("key").alias("ref"), F.col("text").alias("_t"), F.col("final").alias("_f"), F.lit(True).alias("_known")), ["function", "ref"], "left")
    if extra is not None:
        met = met.withColumn("_block", F.substring_index("ref", ".", 1)).join(extra.withColumnRenamed("block", "_block"), ["function", "_block"], "left")
        met = met.withColumn("_t", F.when(F.col("_known").isNotNull(), F.col("_t")).otherwise(F.col("value")))
    fits = F.length("_t") <= MOST_CHARACTERS
    shown = F.when(fits, F.col("_t")).otherwise(F.concat(F.lit("["), F.col("ref"), F.lit("]")))
    settled = F.col("ref").isNull() | F.col("_known").isNull() | F.col("_f") | (F.length("_t") > MOST_CHARACTERS)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("pos", shown.alias("t")))), lambda x: x["t"])
    per = met.groupBy("function", *keys).agg(F.first("_term").alias("_term"), listed.alias("values"), F.bool_and(settled).alias("final"))
    return per.select("function", *keys, substituted(F.col("_term"), F.col("values")).alias("text"), "final")


def _resolved_held(rounds: int, key: list, rule: list, at: list, value: list) -> list[tuple]:
    """(text, final) of each element of one function with distinct keys, as _resolved_rounds has them."""
    pattern, extra = re.compile(REFERENCE, re.ASCII), dict(zip(at, value))
    refs = {k: [m[1:-1] for m in pattern.findall(r)] if r is not None else [] for k, r in zip(key, rule)}
    known = {k: (f"[{k}]", False) if refs[k] else (r, True) for k, r in zip(key, rule)}
    waiting = {k: (pattern.split(r), refs[k]) for k, r in zip(key, rule) if refs[k]}
    for _ in range(rounds):
        if not waiting:
            break
        step = {}
        for k, (between, asked) in waiting.items():
            parts, final = [between[0]], True
            for ref, after in zip(asked, between[1:]):
                text, settled = known[ref] if ref in known else (extra.get(ref.split(".")[0]), True)
                fits = text is not None and len(text) <= MOST_CHARACTERS
                parts += [text if fits else f"[{ref}]", after]
                final = final and (settled or not fits)
            step[k] = "".join(parts), final
        known |= step
        waiting = {k: w for k, w in waiting.items() if not step[k][1]}
    return [known[k] for k in key]


def _in_groups(packed: DataFrame, rounds: int) -> DataFrame:
    """packed (function; e, the elements; v, the bare values) with text and final, a list each in the order of e."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e, v = batch.column("e"), batch.column("v")
            keys, texts = (e.flatten().field(c).to_pylist() for c in ("key", "rule"))
            blocks, values = (v.flatten().field(c).to_pylist() for c in ("at", "value"))
            ends, i, j, found = [0], 0, 0, []
            for m, n in zip(e.value_lengths().to_pylist(), v.value_lengths().to_pylist()):
                found += _resolved_held(rounds, keys[i : i + m], texts[i : i + m], blocks[j : j + n], values[j : j + n])
                i, j = i + m, j + n
                ends.append(i)
            offsets = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array([f[c] for f in found], kind)) for c, kind in ((0, pa.string()), (1, pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column("function"), e, *lists], names=["function", "e", "text", "final"])

    kept = packed.select("function", "e").schema
    return packed.mapInArrow(run, T.StructType([*kept, T.StructField("text", T.ArrayType(T.StringType())), T.StructField("final", T.ArrayType(T.BooleanType()))]))


def resolved_elements(statements: DataFrame, rounds: int = ROUNDS, held_rows: int = HELD_ROWS) -> DataFrame:
    """function, block, key, ordinal, before, text, final: the elements with their references followed so many levels deep.

    A reference to an element that its block doesn't list is the block's last bare value; one to an unknown block stays.
    Functions of at most held_rows elements and bare values are grouped and rewritten one by one; longer ones, those that list
    an element twice, and rows without a function by rounds over tables."""
    elements, extra = settle(rules(statements)), settle(bare_values(statements))
    own = ["block", "key", "ordinal", "rule", "before"]
    rows = elements.select("function", *own).unionByName(extra.select("function", F.col("block").alias("at"), "value"), allowMissingColumns=True)
    counted = rows.groupBy("function").agg(F.count("*").alias("n"))
    long = counted.where((F.col("n") > held_rows) | F.col("function").isNull()).select("function")
    twice = elements.groupBy("function", "key").count().where("count > 1").select("function")
    apart = settle(long.unionByName(twice).distinct())
    pick = lambda when, *c: F.collect_list(F.when(F.col(when).isNotNull(), F.struct(*c)))
    short = rows.where("function IS NOT NULL").join(apart, "function", "left_anti")
    per = short.groupBy("function").agg(pick("key", *own).alias("e"), pick("at", "at", "value").alias("v"))
    each = F.explode(F.arrays_zip("e", "text", "final")).alias("x")
    found = _in_groups(per, rounds).select("function", each).select("function", *[f"x.e.{c}" for c in ("block", "key", "ordinal", "before")], "x.text", "x.final")
    if not apart.take(1):
        return found
    met = lambda df: df.join(apart, df["function"].eqNullSafe(apart["function"]), "left_semi")
    return found.unionByName(_resolved_rounds(settle(met(elements)), settle(met(extra)), rounds).select(*found.columns))


def _resolved_rounds(elements: DataFrame, extra: DataFrame, rounds: int) -> DataFrame:
    plain = ~F.col("rule").rlike(REFERENCE)
    done = [settle(elements.where(F.coalesce(plain, F.lit(True))).select("function", "key", F.col("rule").alias("text"), F.lit(True).alias("final")))]
    waiting = settle(elements.where(~plain).select("function", "key", "rule"))
    states = settle(waiting.select("function", "key", F.concat(F.lit("["), "key", F.lit("]")).alias("text"), F.lit(False).alias("final")))
    for _ in range(rounds):
        if not waiting.take(1):
            break
        known = states
        for part in done:
            known = known.unionByName(part)
        step = settle(_rewritten(waiting, ["key"], "rule", known, extra))
        left = settle(waiting.join(step.where("NOT final").select("function", "key"), ["function", "key"], "left_semi"))
        for old in (waiting, states):
            discard(old)
        done.append(settle(step.where("final")))
        waiting, states = left, settle(step.where("NOT final"))
        discard(step)
    texts = states
    for part in done:
        texts = texts.unionByName(part)
    return elements.join(texts, ["function", "key"]).select("function", "block", "key", "ordinal", "before", "text", "final")


def terminator_condition(text: Column) -> Column:
    """What an if, while or for tests: what follows the kind of syntax node if anything does, else the reference before it;
    null for other terminators."""
    trimmed = F.trim(text)
    word = F.regexp_extract(trimmed, r"^([a-z]+)\b", 1)
    rest = F.trim(F.substring(trimmed, F.length(word) + 1, F.length(trimmed)))
    after = F.trim(F.regexp_extract(rest, r"^\[\w+\.\d+\]\s*\([A-Z]\w*(?:,[^()\[\]]*)?\)(.*)$", 1))
    before = F.regexp_extract(rest, r"^(\[\w+\.\d+\])\s*\([A-Z]\w*(?:,[^()\[\]]*)?\)\s*$", 1)
    return F.when(word.isin(*TESTING), F.when(after != "", after).when(before != "", before).otherwise(_bare(rest)))


def resolved_conditions(terminators: DataFrame, statements: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """function, block, condition, resolved: the condition of every testing terminator in source form.

    terminators: function, block, text. A comparison without a left side compares the block's last element. Where the left
    element of a comparison is that comparison itself, the element before it is meant. An operand that nothing is known of is `?` in
    a comparison, and stays a reference elsewhere."""
    elements = settle(resolved_elements(statements, rounds))
    asked = terminators.select("function", "block", terminator_condition(F.col("text")).alias("condition")).where("condition IS NOT NULL")
    last = elements.groupBy("function", "block").agg(F.max_by("key", "ordinal").alias("last"))
    operator = F.regexp_extract("condition", r"^(?:\[\w+\.\d+\])?\s*([=!<>]=|[<>])\s*\[\w+\.\d+\]$", 1)
    left = F.regexp_extract("condition", r"^\[(\w+\.\d+)\]", 1)
    asked = asked.join(last, ["function", "block"], "left").withColumns({"operator": operator, "left": F.when(operator != "", left)})
    own = elements.select("function", F.col("key").alias("left"), F.col("text").alias("_own"), F.col("before").alias("_before"))
    asked = asked.join(own, ["function", "left"], "left")
    bracket = lambda c: F.concat(F.lit("["), c, F.lit("]"))
    implied = (F.col("operator") != "") & (F.col("left") == "")
    itself = (F.col("operator") != "") & F.contains("_own", F.col("operator"))
    term = (
        F.when(implied, F.concat(F.coalesce(bracket(F.col("last")), F.lit("?")), F.lit(" "), "condition"))
        .when(itself, F.concat(F.coalesce("_before", F.lit("?")), F.lit(" "), F.substring("condition", F.length("left") + 3, 1 << 20))).otherwise(F.col("condition"))
    )
    asked = settle(asked.select("function", "block", "condition", "operator", F.regexp_replace(term, r"\s+", " ").alias("term")).dropDuplicates(["function", "block"]))
    told = _rewritten(asked, ["block"], "term", elements.select("function", "key", "text", "final"), bare_values(statements))
    named = F.when(F.col("operator") != "", F.regexp_replace("text", REFERENCE, "?")).otherwise(F.col("text"))
    return asked.join(told, ["function", "block"]).select("function", "block", "condition", named.alias("resolved"))
