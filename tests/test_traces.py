"""Trace operators against plain Python and hand-made cases."""

import itertools
import json

import pytest

from strandline.operators import traces as T
from strandline.plans import trace_plans


def test_events_match_nodes_exactly_or_within_the_band(spark):
    events = spark.createDataFrame([(1, "/b/src/a.cpp", 10), (2, "a.cpp", 30), (3, "other/a.cpp", 0), (4, "c.cpp", 10)], "event int, file string, line int")
    nodes = spark.createDataFrame([("n1", "src/a.cpp", 10), ("n2", "src/a.cpp", 12), ("n3", "src/a.cpp", 33), ("n4", "src/a.cpp", 0)], "node string, source_file string, source_line int")
    assert {tuple(r) for r in T.match_events(events, nodes).collect()} == {(1, "n1", 0), (2, "n3", 3)}


def test_annotations_take_the_last_direction(spark):
    events = spark.createDataFrame([(1, "a.c", 5, True), (2, "a.c", 5, False), (3, "a.c", 9, None)], "step int, file string, line int, direction boolean")
    predicates = spark.createDataFrame([("g", "x/a.c", 5), ("f", "x/a.c", 5), ("f", "x/a.c", 9)], "function_name string, source_file string, source_line int")
    assert [tuple(r) for r in T.path_annotations(events, predicates).collect()] == [("f", 5, False)]


def test_assumption_forms(spark):
    rows = [
        ("Assuming field 'sep' is true", ("sep", "==", "true")), ("Assuming pointer value is non-null", None), ("Assuming 'p' is non-null", ("p", "!=", "null")), ("Assuming the condition is false", ("condition@L7", "==", "false")),
        ("Assuming field 'n' is >= 4", ("n", ">=", "4")), ("Assuming 'a' is equal to field 'b'", ("a", "==", "b")), ("Null pointer value stored to 'q'", ("q", "==", "null")), ("Value '3' stored to 'x'", ("x", "==", "3")), ("walks on", None),
    ]
    found = T.assumptions(spark.createDataFrame([(t, 7) for t, _ in rows], "message string, line int")).collect()
    got = {r["message"]: (r["variable"], r["operator"], r["value"]) for r in found}
    assert got == {t: w for t, w in rows if w} | ({"Assuming pointer value is non-null": got["Assuming pointer value is non-null"]} if "Assuming pointer value is non-null" in got else {})


def test_alignment_finds_the_shift(spark):
    text = [f"line number {i} of it" for i in range(40)] + ["short"]
    lines = spark.createDataFrame([("k", i + 1, t) for i, t in enumerate(text)], "k string, line int, text string")
    probes = spark.createDataFrame([("k", i + 4, text[i] + "  ") for i in range(10, 16)] + [("k", 2, "short"), ("k", 3, "nowhere to be found")], "k string, line int, text string")
    assert [tuple(r) for r in T.line_alignment(probes, lines, "k").collect()] == [("k", -3, 6, 6)]


def test_slice_counts_hops_between_functions_only(spark):
    chain = [(f"a{i + 1}", f"a{i}", "data") for i in range(12)] + [("b0", "a12", "call"), ("b1", "b0", "control"), ("c0", "b1", "call"), ("a3", "a0", "control")]
    df = spark.createDataFrame(chain, "src string, dst string, kind string")
    seeds = spark.createDataFrame([("a0",)], "node string")
    found = {r["node"]: r["hops"] for r in T.interprocedural_slice(df, seeds, max_hops=1).collect()}
    assert found == {f"a{i}": 0 for i in range(13)} | {"b0": 1, "b1": 1}
    pruned = {r["node"] for r in T.interprocedural_slice(df, seeds, spark.createDataFrame([("b1",)], "node string")).collect()}
    assert "b1" not in pruned and "c0" not in pruned and "b0" in pruned


@pytest.mark.parametrize("n", [3, 9])
def test_paths_equal_the_walk(spark, n):
    verdicts = ["insufficient_info", "consistent", "contradictory"] * 3
    above = {1: [], 4: ["n2"], 5: ["n1"]}
    rows = [("s", i, f"n{i}", verdicts[i] if n == 3 else "contradictory" if i == 2 else None, i + 1, [f"v{i % 2}"] * (i % 3), i % 2 == 0, i == 0, above.get(i, []) if n == 9 else []) for i in range(n)]
    df = spark.createDataFrame(rows, "seg string, position int, node string, verdict string, statements long, variables array<string>, is_taken boolean, is_call boolean, ancestors array<string>")
    open_ = [r for r in rows if r[3] != "contradictory" and "n2" not in r[8]]
    walk = list(itertools.product(*[[r[6]] if r[3] == "consistent" else [True, False] for r in open_]))[:200]
    metric = (sum(r[4] + r[7] for r in open_), sum(r[7] for r in open_), sum(len(r[5]) for r in open_))
    wanted = [(tuple((r[2], t) for r, t in zip(open_, p)), *metric) for p in walk]
    found = [(tuple((d["node"], d["taken"]) for d in r["decisions"]), r["S"], r["C"], r["V"]) for r in T.enumerate_paths(df, "seg").orderBy("path").collect()]
    assert found == wanted


def test_many_roots_are_walked_greedily(spark):
    rows = [("s", i, f"n{i}", "consistent" if i == 1 else None, 1, ["v"]) for i in range(20)]
    df = spark.createDataFrame(rows, "seg string, position int, node string, verdict string, statements long, variables array<string>")
    found = [[d["node"] for d in r["decisions"] if not d["taken"]] for r in T.enumerate_paths(df, "seg", k=1).orderBy("path").collect()]
    assert found == [[], ["n0"], ["n2"]]
    deep = spark.createDataFrame([("s", i, f"n{i}", None, 1, ["v"]) for i in range(70)], df.schema)
    last = T.enumerate_paths(deep, "seg", greedy_above=100).orderBy("path").collect()
    assert len(last) == 200 and [d["node"] for d in last[5]["decisions"] if not d["taken"]] == ["n67", "n69"]


def test_exclusive_groups_and_adapters(spark):
    rows = [("f", "n1", "h == 1"), ("f", "n2", "h == 2"), ("f", "n3", "h >= 3"), ("g", "n4", "h == 1"), ("f", "n5", "(k == 7)")]
    found = T.exclusive_groups(spark.createDataFrame(rows, "function_name string, node string, condition string")).collect()
    assert [(r["function_name"], r["name"], r["nodes"], r["constants"]) for r in found] == [("f", "h", ["n1", "n2"], [1, 2])]
    docs = [("a.html", "<!-- BUGTYPE x -->"), ("b.sarif", "{}"), ("c", '{"version": "2.1.0", "runs": []}'), ("d.txt", "nothing"), ("e", "[B2 (ENTRY)]")]
    ranked = {r["path"]: r["adapter"] for r in T.rank_adapters(spark.createDataFrame(docs, "path string, content string")).collect()}
    assert ranked == {"a.html": "csa_html", "b.sarif": "sarif", "c": "sarif", "d.txt": None, "e": "cfg_text"}


def test_closure_brings_one_new_file_per_name(spark):
    definitions = [("helper", "z.c", 1, False), ("helper", "a.c", 0, True), ("known", "here.c", 0, True), ("run", "r.c", 0, True), ("other", "a.c", 2, False)]
    found = T.close_over_names(spark.createDataFrame([("helper",), ("known",), ("run",), ("other",), ("main",)], "name string"), spark.createDataFrame(definitions, "name string, file string, ordinal int, qualified boolean"), spark.createDataFrame([("here.c",)], "file string"))
    assert [tuple(r) for r in found.collect()] == [("helper", "a.c")]


def test_conditions_and_repairs():
    facts = {"n": "SIZE", "SIZE": "(LIM - 2)", "LIM": "10u", "p->x": "0"}
    assert T.evaluate("n == 8 && !p->x", facts) is True and T.evaluate("n < 8 || p->x", facts) is False
    assert T.evaluate("unknown > 1", facts) is None and T.evaluate("f(1)", facts) is None and T.evaluate(None, facts) is None and T.evaluate("1 / 0", {}) is None
    assert T.evaluate("a", {"a": "a + a"}) is None
    as_in_c = {
        "!x == 1": False, "a < b < c": True, "x & 2 == 2": False, "-7 % 3 == -1": True, "-7 / 2 == -3": True, "1 ? 0 : 1": False, "0 ? 0 : x ? 0 : 1": False, "x == 2 ? 3 : 0": True, "'a' == 97": True, "'\\n' == 10": True,
        "0x10 == 16 && 010 == 8u": True, "1 << 3 >> 2 == 2": True, "1 | 2 ^ 3 & 4": True, "~0 == -1": True, "1.5 * 2 == 3": True, "f(1, (2)) || 1": True, "f(1) && 0": False, "1 || 1 / 0": True, "u && 1": None, "u ? 1 : 1": True,
        "u ? 1 : 0": None, "arr[2] == 1": None, "(int)x": None, "1 +": None, "": None, "x = 1": None, "1 2": None, "(": None, ")": None, "1 ? 2": None, "1 : 2": None, "null == 0": True, "--x == 2": None, "f(\"a)\", x) || x": True, "x, 1": None, "(1": None,
    }
    for text, holds in as_in_c.items():
        assert T.evaluate(text, {"x": "2", "a": "3", "b": "2", "c": "2"}) is holds, text
    assert T.evaluate(" && ".join(["(1 + 1 == 2)"] * 5_000), {}) is True and T.evaluate("(" * 5_000 + "1" + ")" * 5_000, {}) is True
    assert T.repair('text {"a": [1, 2]} more') == ('{"a": [1, 2]}', False)
    document, cut = T.repair('{"a": [{"b": "x\\"y"}, {"b": "cut')
    assert cut and json.loads(document)["a"][0] == {"b": 'x"y'}
    assert T.repair("no object") == (None, True) and T.repair(None) == (None, True)


def test_enumerated_paths_of_long_orders_are_all_counted(spark, tmp_path):
    """Sixteen open lines are more roots than the greedy walk starts at; the SQL counts up to 200 paths all the same."""
    rows = [(o, 10 * o + i, i, i, 1.0, 0.5, 0.0, "N") for o, n in ((1, 16), (2, 2)) for i in range(n)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_tax double, l_extendedprice double, l_returnflag string")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    assert {tuple(r) for r in trace_plans.enumerated_paths(spark, str(tmp_path)).select("l_orderkey", "n_paths").collect()} == {(1, 200), (2, 4)}
