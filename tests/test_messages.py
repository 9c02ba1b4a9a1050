"""Messages read into fields, what they refute, and expressions and patterns that must not end a task."""

import pytest
from pyspark.sql import functions as F

from strandline.functions import messages as M
from strandline.functions import text as X
from strandline.functions.c_expression import truth
from strandline.operators import structure as S
from strandline.operators.branches import branch_verdict
from strandline.sources import graphs

SAID = {
    "Assuming 'n' is equal to 0": ("n", "==", "0"), "Assuming 'n' is not equal to field 'm'": ("n", "!=", "m"), "Assuming field 'a->b' is <= -3": ("a->b", "<=", "-3"), "assuming the condition is True": ("condition", "==", "true"),
    "Assuming pointer value is null": ("pointer value", "==", "null"), "Assuming the pointer value is null": ("pointer value", "==", "null"), "Assuming pointer value 'p' is non-null": ("p", "!=", "null"), "Assuming ptr is null": ("ptr", "==", "null"),
    "Assuming 'a b' is > 7": ("a b", ">", "7"), "Assuming 'p' is null here": ("p", "==", "null"), "Assuming 'p' is odd": None, "Assuming 'p'": None, "Assuming": None, "Taking true branch": None, "x is equal to 3": None, "": None, None: None,
    "Assuming 'x' is equal to": None, "Assuming that 'x' is 3": None,
}
STORED = {
    "Null pointer value stored to 'p'": ("p", "null"), "null pointer value stored to field 'q'": ("q", "null"), "Value 3 is stored to 'x'": ("x", "3"), "The value '0' is assigned to field 'y'": ("y", "0"), "stored to 'z'": None,
    "Value 3 stored to x": None, None: None, "'x' initialized here": None,
}
LOADED = {"Dereference of null pointer (loaded from variable 'p')": "p", "read from the memory 'm'": "m", "loaded from field \"f\"": "f", "loaded from 'q' maybe": "q", "loaded from somewhere 'q'": None, "'p' is null": None, None: None}


@pytest.mark.parametrize(("said", "read", "fields"), [(SAID, M.assumed, ("subject", "operator", "value")), (STORED, M.stored, ("subject", "value"))])
def test_messages_read_into_fields(spark, said, read, fields):
    df = spark.createDataFrame([(m,) for m in said], "m string").select("m", read(F.col("m")).alias("r"))
    assert {r["m"]: r["r"] and tuple(r["r"][f] for f in fields) for r in df.collect()} == said


def test_loads_name_their_variable(spark):
    df = spark.createDataFrame([(m,) for m in LOADED], "m string").select("m", M.loaded(F.col("m")).alias("r"))
    assert {r["m"]: r["r"] for r in df.collect()} == LOADED


def test_conditions_are_refuted_only_plainly(spark):
    cases = [
        ("x == 5", "Assuming 'x' is not equal to 5", True), ("x == 5", "Assuming 'x' is equal to 5", False), ("x > 5", "Assuming 'x' is <= 5", True), ("x > 5", "Assuming 'x' is <= 6", False), ("x == 5 || y", "Assuming 'x' is not equal to 5", False),
        ("x == 5 && y", "Assuming 'x' is not equal to 5", True), ("(x == 5 && z) || y", "Assuming 'x' is not equal to 5", False), ("y || (x == 5 && z)", "Assuming 'y' is false", False), ("y", "Assuming 'y' is false", True), ("!y", "Assuming 'y' is true", True),
        ("p", "Assuming 'p' is null", True), ("p != nullptr", "Assuming pointer value 'p' is null", True), ("anything at all", "Assuming the condition is false", True), ("anything", "Assuming the condition is true", False), ("x == 5 || x == 6", "Assuming 'x' is equal to 7", True),
        ("f(x) == 5", "Assuming 'x' is not equal to 5", False), (None, "Assuming 'x' is null", False), ("x == LIMIT", "Assuming 'x' is equal to 7", False), ("xx == 5", "Assuming 'x' is not equal to 5", False),
    ]
    df = spark.createDataFrame([(i, c, m) for i, (c, m, _) in enumerate(cases)], "i int, c string, m string").select("i", S.falsified(F.col("c"), F.col("m")).alias("r"))
    found = {r["i"]: r["r"] for r in df.collect()}
    assert [(c, m, found[i]) for i, (c, m, _) in enumerate(cases)] == cases


def test_short_circuits_look_at_the_operand(spark):
    source = "void f() {\n  if (x == 5 ||\n      y) { a(); }\n  if (p &&\n      q->r) { b(); }\n  if (f(x) ||\n      y) { c(); }\n  if (x ||\n      y && z) { d(); }\n}\n"
    controls = S.control_statements(spark.createDataFrame([("a.c", source)], "file string, content string")).cache()
    said = [(2, "Assuming 'x' is not equal to 5"), (2, "Assuming 'x' is <= 5"), (2, "Assuming 'x' is equal to 5"), (2, "Assuming 'x' is > 5"), (4, "Assuming 'p' is null"), (4, "Assuming 'p' is non-null"), (6, "Assuming 'x' is equal to 5"), (8, "Assuming 'x' is true"), (2, None)]
    events = spark.createDataFrame([(f"r{i}", "a.c", line, m) for i, (line, m) in enumerate(said)], "report_key string, file string, line int, message string")
    assert {tuple(r) for r in S.short_circuits(events, controls).collect()} == {("r2", "a.c", 3, "first operand is true"), ("r4", "a.c", 5, "first operand is false")}


@pytest.mark.parametrize(("text", "facts", "wanted"), [
    ("-1 < 1u", {}, False), ("-1 > 1u", {}, True), ("x - 3u >= 0", {"x": "2"}, None), ("x - 3u >= 0", {"x": "5"}, True), ("x - 3u == 2", {"x": "5"}, True), ("-2 < -1u", {}, None), ("-1 == 1u", {}, False), ("-1 < 1", {}, True),
    ("7u / 2u == 3", {}, True), ("1 ? 0 ? 5 : 0 : 7", {}, False), ("1 ? 1 ? 5 : 0 : 0", {}, True), ("0 ? 1 ? 5 : 0 : 7", {}, True), ("0 ? 1 : 1 ? 0 : 1", {}, False), ("1 ? 0 ? 1 : 0 ? 1 : 0 : 1", {}, False), ("-x < 0", {"x": "1u"}, None), ("~0u", {}, None),
])
def test_unsigned_numbers_and_nested_choices(text, facts, wanted):
    assert truth(text, facts) is wanted


def test_long_repeats_end_no_task(spark):
    n = 100_000
    rows = [("x" + ".b" * n,), ("x" + "->b" * n + " == 1",), ('"' + "\\n" * n + '" // c',), ('"' + "a" * n,), ("a" * n,), ('a"b c"' * n,), ("!!" * n + "p",), ("!" + "a->b" * n,)]
    df = spark.createDataFrame(rows, "t string")
    t = F.col("t")
    found = df.select(F.size(X.identifiers(t)).alias("i"), F.length(X.strip_comment(t)).alias("s"), X.equality_leaf(t).alias("e"), M.assumed(t).alias("a"), branch_verdict(t, F.lit(True), F.lit("p > 0")).alias("v")).collect()
    assert found[0]["i"] == 1 and found[2]["s"] == 2 and len(found) == len(rows)
    command = '[{"directory": "d", "file": "f", "command": "cc -D' + "a" * n + '"}]'
    assert graphs.read_compile_database(spark.createDataFrame([("p", command)], "path string, content string")).collect()[0]["arguments"][1] == "-D" + "a" * n
