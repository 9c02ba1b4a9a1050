"""Operators without SQL against plain Python, and the quirks that a port could get wrong."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.functions import constraints as C
from strandline.functions import text as X
from strandline.operators import enumeration, gates, graph, joins, sequences


def graph_of(seed, n=9, m=16):
    rng = random.Random(seed)
    edges = {(rng.randrange(1, n), rng.randrange(1, n)) for _ in range(m)} | {(rng.randrange(1, n), 0)}
    return sorted((a, b) for a, b in edges if a != b)


def closure(edges, start):
    seen, todo = {start}, [start]
    while todo:
        x = todo.pop()
        for a, b in edges:
            if a == x and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_post_dominators_and_control_dependence(spark, seed):
    edges = graph_of(seed)
    nodes = {x for e in edges for x in e}
    live = {x for x in nodes if 0 in closure(edges, x)}
    dom = {(x, d) for x in live for d in live if d == x or 0 not in closure([e for e in edges if d not in e], x) or d == 0}
    df = spark.createDataFrame(edges, "src long, dst long")
    assert {tuple(r) for r in graph.post_dominators(df, 0).collect()} == dom
    wanted = {(a, d) for a, b in edges if a in live for x, d in dom if x == b and not ((a, d) in dom and a != d)}
    assert {tuple(r) for r in graph.control_dependence(df, 0).collect()} == wanted


def test_reaching_definitions_with_loop(spark):
    flow = [(1, 2), (2, 3), (3, 2), (3, 4)]
    blocks = [(1, "x", 10), (3, "x", 30), (1, "y", 11)]
    found = graph.reaching_definitions(spark.createDataFrame(blocks, "block long, variable string, definition long"), spark.createDataFrame(flow, "src long, dst long"))
    assert {tuple(r) for r in found.collect()} == {(2, "x", 10), (2, "y", 11), (2, "x", 30), (3, "x", 10), (3, "x", 30), (3, "y", 11), (4, "x", 30), (4, "y", 11)}


def test_slice_takes_least_depth_and_stops_at_the_limit(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4)], "src long, dst long")
    seeds = spark.createDataFrame([(4,), (None,)], "node long")
    assert {tuple(r) for r in graph.backward_slice(edges, seeds).collect()} == {(4, 0), (3, 1), (2, 2), (1, 2)}
    assert {r["node"] for r in graph.backward_slice(edges, seeds, max_depth=1).collect()} == {3, 4}
    assert graph.backward_slice(edges, seeds.limit(0)).count() == 0


def test_caller_of_equals_a_stack_machine(spark):
    rng = random.Random(5)
    rows = [(k, i, rng.choice(["push", "pop", "other"]), rng.choice("abc")) for k in range(4) for i in range(40)]
    wanted = {}
    for k in range(4):
        stack = []
        for _, i, what, name in (r for r in rows if r[0] == k):
            if what == "push":
                wanted[k, name] = stack[-1] if stack else None
                stack.append(name)
            elif what == "pop" and stack:
                stack.pop()
    df = spark.createDataFrame(rows, "k int, i int, what string, name string")
    found = sequences.caller_of(df, "k", ["i"], F.col("what") == "push", F.col("what") == "pop", "name")
    assert {(r["k"], r["callee"]): r["caller"] for r in found.collect()} == wanted


def test_band_join_meets_each_pair_once(spark):
    rng = random.Random(3)
    left, right = [(i, rng.randrange(-40, 40)) for i in range(60)], [(i, rng.randrange(-40, 40)) for i in range(60)]
    found = joins.band_join(spark.createDataFrame(left, "a long, x long"), spark.createDataFrame(right, "b long, y long"), "x", "y", 5)
    got = [(r["a"], r["b"]) for r in found.collect()]
    assert sorted(got) == sorted((a, b) for a, x in left for b, y in right if abs(x - y) <= 5)


def test_constraint_notions_differ(spark):
    rows = [("==", 1.0, "==", 2.0), ("==", 1.0, ">=", 5.0), (">", 3.0, "<=", 3.0), (">=", 3.0, "<=", 3.0), ("!=", 1.0, "==", 1.0), ("<", 0.0, ">", 0.0)]
    df = spark.createDataFrame(rows, "p string, a double, q string, b double")
    args = [F.col(c) for c in ("p", "a", "q", "b")]
    got = df.select(C.intervals_clash(*args), C.ranges_intersect(*args), C.integers_clash(*args)).collect()
    assert [r[0] for r in got] == [True, True, True, False, True, True]
    assert [r[1] for r in got] == [False, False, False, True, False, False]
    assert [r[2] for r in got] == [True, False, True, False, True, True]


def test_literals_and_postconditions(spark):
    df = spark.createDataFrame([("0x10",), ("-3",), ("7u",), ("nullptr",), ("MAX_LEN",), ("",)], "t string")
    assert [r[0] for r in df.select(C.to_number(F.col("t"))).collect()] == [16.0, -3.0, 7.0, 0.0, None, None]
    met = df.select(C.satisfies(F.col("t"), F.lit(">="), F.lit("0"))).collect()
    assert [r[0] for r in met] == [True, False, True, True, True, True]


def test_text_operators(spark):
    df = spark.createDataFrame([("if (this->a == MAX && b.c >= n) // note",)], "t string")
    assert df.select(X.identifiers(X.strip_comment(F.col("t")))).first()[0] == ["this->a", "MAX", "b.c", "n"]
    leaf = spark.createDataFrame([("h == 5",), ("FOO_BAR == p->x",), ("a >= 2",)], "t string").select(X.equality_leaf(F.col("t")).alias("l")).collect()
    assert [tuple(r["l"]) if r["l"] else None for r in leaf] == [("h", "5"), ("p->x", "FOO_BAR"), None]
    edge = spark.createDataFrame([("callee_foo_to_ascii_L100_B3",)], "t string")
    assert edge.select(X.normal_call_edge(F.col("t"))).first()[0] == "callee_foo_to_ascii_B3"


def test_combinations_equal_the_ranked_product(spark):
    import itertools

    sizes = [3, 2, 4]
    wanted = sorted((sum(c), i, list(c)) for i, c in enumerate(itertools.product(*map(range, sizes))))[:7]
    found = [(r["rank_sum"], r["combo"], r["ranks"]) for r in enumeration.bounded_combinations(spark, sizes, given_out=7).collect()]
    assert sorted(found) == wanted


def test_verdicts_stay_conservative(spark):
    rows = [
        ("a", "FP", True, None, False), ("a", "FP", True, True, False), ("b", "FP", False, None, False), ("c", "TP", False, None, True), ("c", "FP", True, None, True), ("d", "FP", False, None, True), ("e", None, None, None, None),
        ("contradiction", "FP", True, None, True), ("contradiction", "FP", True, None, True), ("contradiction", "TP", True, None, True),
        ("one witness", "FP", True, None, False), ("one witness", "UNKNOWN", False, None, False), ("strays", "FP", True, False, False), ("strays", "FP", True, False, False),
    ]
    found = gates.explored_verdict(spark.createDataFrame(rows, "report_key string, verdict string, leak boolean, conforms boolean, exhausted boolean"))
    assert {r["report_key"]: (r["verdict"], r["reason"]) for r in found.collect()} == {
        "a": ("FP", "leak consensus"), "b": ("UNKNOWN", "undecided"), "c": ("TP", "reachable"), "d": ("FP", "space exhausted"), "e": ("UNKNOWN", "undecided"),
        "contradiction": ("UNKNOWN", "leak contradiction"), "one witness": ("UNKNOWN", "undecided"), "strays": ("UNKNOWN", "undecided"),
    }


STEPS = [(1, "event", 5, "Assuming pointer value is null", None), (2, "event", 7, "Taking true branch", True), (3, "report", 9, "Dereference of null pointer (loaded from variable 'out')", None)]
CHANGED = {
    "holds": {}, "error start first": {"before": (0, "error_start", 5, "Error Start", None)}, "brackets": {"condition": "((out != nullptr))"}, "twice not": {"condition": "!!out"},
    "other claim first": {"before": (0, "event", 4, "Calling 'f'", None), "none": True}, "opposite": {"condition": "out == nullptr", "none": True}, "one not": {"condition": "!out", "none": True},
    "compound": {"condition": "out != nullptr && n", "none": True}, "other variable": {"condition": "outer != nullptr", "none": True}, "value parameter": {"parameters": "int out", "none": True},
    "a longer name": {"parameters": "char *outer, int out", "none": True}, "not taken": {"direction": False, "none": True}, "no direction": {"direction": None, "none": True}, "after the dereference": {"check_line": 11, "none": True},
    "left out of releases": {"macro": "DCHECK", "none": True}, "outside": {"high": 8, "none": True}, "no null bug": {"bug": "Memory leak", "none": True}, "stored before": {"between": (1.5, "event", 6, "Value 0 is assigned to 'out'", None), "none": True},
}


def test_entry_state_gate_claims_only_what_it_can_show(spark):
    reports, steps, functions, checks = [], [], [], []
    for k, c in CHANGED.items():
        reports.append((k, c.get("bug", "Dereference of null pointer")))
        for n, kind, line, message, direction in [*STEPS, *[c[x] for x in ("before", "between") if x in c]]:
            if direction is not None:
                direction, line = c.get("direction", direction), c.get("check_line", line)
            steps.append((k, float(n), kind, k, line, message, direction))
        functions.append((k, "f", c.get("parameters", "const T *in, char *out"), 3, c.get("high", 20)))
        checks.append((k, c.get("check_line", 7), c.get("macro", "CHECK"), c.get("condition", "out != NULL")))
    found = gates.fabricated_entry_state(
        spark.createDataFrame(reports, "report_key string, bug_type string"), spark.createDataFrame(steps, "report_key string, step double, kind string, file string, line int, message string, direction boolean"),
        spark.createDataFrame(functions, "file string, name string, parameters string, low int, high int"), spark.createDataFrame(checks, "file string, line int, macro string, condition string"),
    )
    assert {r["report_key"] for r in found.collect()} == {k for k, c in CHANGED.items() if not c.get("none")}


def test_band_look_ups_equal_brute_force(spark):
    rng = random.Random(11)
    left = [(i, rng.randrange(0, 60)) for i in range(50)] + [(50, None)]
    right = [(i, rng.randrange(0, 60), rng.random() < 0.3) for i in range(80)] + [(80, None, True)]
    a, b = spark.createDataFrame(left, "a long, x long"), spark.createDataFrame(right, "b long, y long, p boolean")
    tiers, nearest = {}, {}
    for i, x in left:
        near = [(j, y, p) for j, y, p in right if None not in (x, y) and abs(x - y) <= 2]
        if near:
            exact = [j for j, y, _ in near if y == x]
            tiers[i] = (0, len(exact), min(exact)) if exact else (1, len(near), min(j for j, _, _ in near))
            nearest[i] = min((abs(x - y) - p, j) for j, y, p in near)
    assert {r[0]: tuple(r)[1:] for r in joins.tiered_match(a, b, "a", "x", "b", "y", 2).collect()} == tiers
    assert {r[0]: tuple(r)[1:] for r in joins.nearest_match(a, b, "a", "x", "b", "y", 2, (), F.col("p")).collect()} == nearest


def test_tightest_range_equals_brute_force(spark):
    rng = random.Random(12)
    ranges = [(f"r{i}", low, low + rng.choice([0, 1, 3, 4, 7, 8, 1000])) for i, low in enumerate(rng.choices(range(-50, 50), k=40))]
    points = [(i, rng.randrange(-80, 200)) for i in range(60)]
    wanted = {i: min((h - lo, n) for n, lo, h in ranges if lo <= x <= h) for i, x in points if any(lo <= x <= h for _, lo, h in ranges)}
    p, r = spark.createDataFrame(points, "i long, x long"), spark.createDataFrame(ranges, "name string, low long, high long")
    found = joins.tightest_range(p, r, "i", "x", "low", "high", "name").collect()
    assert {f["i"]: (f["span"], f["name"]) for f in found} == wanted
    assert joins.tightest_range(p, r.limit(0), "i", "x", "low", "high", "name").count() == 0


def test_call_nodes_equal_brute_force(spark):
    rng = random.Random(13)
    nodes = [(n, f"{rng.choice(['src/', 'lib/x'])}{rng.choice('abc')}.c", rng.randrange(40), i) for i, n in enumerate(dict.fromkeys("::".join(rng.choices("pqrs", k=rng.randint(1, 3))) for _ in range(40)))]
    asked = [(i, "::".join(rng.choices("pqrst", k=rng.randint(1, 2))), rng.choice(["", None, "a.c", "src/b.c", "c", "z.c"]), rng.choice([None, 3, 17, 30])) for i in range(60)]

    def resolve(name, file, line):
        if found := [n for n in nodes if n[0] == name]:
            return "exact", found[0][0]
        if file and line is not None and (found := [n for n in nodes if n[1].endswith(file) and abs(n[2] - line) <= 5]):
            return "place", found[0][0]
        if found := [n for n in nodes if n[0] == name or n[0].endswith("::" + name)]:
            return "suffix", found[0][0]
        return "unresolved", None

    found = joins.call_nodes(spark.createDataFrame(asked, "ask int, name string, file string, line int"), spark.createDataFrame(nodes, "id string, file string, line int, ordinal int"))
    assert {r["ask"]: (r["strategy"], r["node"]) for r in found.collect()} == {a[0]: resolve(*a[1:]) for a in asked}


def test_linked_calls_takes_the_last_node_or_makes_one(spark):
    calls = spark.createDataFrame([("f", 1, "g"), ("f", 2, "g"), ("h", 1, "g"), ("f", None, "g")], "function string, line int, callee string")
    nodes = spark.createDataFrame([("f", 1, 0, "n0"), ("f", 1, 5, "n5")], "function string, line int, ordinal int, id string")
    got = {(r["function"], r["line"]): (r["node"], r["synthesized"]) for r in joins.linked_calls(calls, nodes).collect()}
    assert got["f", 1] == ("n5", False) and all(got[k][1] for k in [("f", 2), ("h", 1), ("f", None)])
    assert len({v[0] for v in got.values()}) == 4


def test_functions_need_no_rounds_and_long_ones_give_the_same(spark, monkeypatch):
    """Random graphs as functions, held or by rounds over tables; held ones are settled once, whatever the way through them."""
    edges = [(f"f{seed}", a, b) for seed in (1, 2) for a, b in graph_of(seed)]
    flow = spark.createDataFrame(edges, "function string, src long, dst long")
    rng = random.Random(2)
    blocks = spark.createDataFrame([(f, b, v, 10 * b) for f, b in sorted({(f, b) for f, *e in edges for b in e}) for v in "xy" if rng.random() < 0.5], "function string, block long, variable string, definition long")
    rows = lambda df: sorted(tuple(r) for r in df.select(*sorted(df.columns)).collect())
    settled, settle = [], graph.settle
    monkeypatch.setattr(graph, "settle", lambda df: settled.append(1) or settle(df))
    control, reaching = rows(graph.control_dependence(flow, 0, "function")), rows(graph.reaching_definitions(blocks, flow, "function"))
    assert len(settled) == 2 and control and reaching
    assert rows(graph.control_dependence(flow, 0, "function", held_rows=10)) == control and rows(graph.reaching_definitions(blocks, flow, "function", held_rows=10)) == reaching
    assert len(settled) > 10
