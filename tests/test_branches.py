"""Branch operators on hand-made cases."""

from pyspark.sql import functions as F

from strandline.operators import branches as B


def test_branch_verdicts(spark):
    rows = [
        ("r >= 10", True, "r < 10", "contradictory"), ("r >= 10", False, "r < 10", "consistent"), ("x->n == 3", True, "n == 4", "contradictory"), ("n == 3", True, "n != 3", "contradictory"),
        ("p", True, "p == NULL", "contradictory"), ("!p", True, "p == nullptr", "consistent"), ("a > 1", True, "b > 1", "insufficient_info"), ("f(x)", True, "x > 1", "insufficient_info"), ("n <= 5", True, "n >= 5", "consistent"),
    ]
    df = spark.createDataFrame(rows, "c string, t boolean, k string, want string")
    got = df.select("c", "k", "want", B.branch_verdict(F.col("c"), F.col("t"), F.col("k")).alias("v")).collect()
    assert [(r["c"], r["k"], r["v"]) for r in got] == [(r["c"], r["k"], r["want"]) for r in got]


def test_shortest_paths_filter_and_fall_back(spark):
    rows = [("s", 1, "a", None, 5, ["x"]), ("s", 2, "b", None, 1, ["x"]), ("t", 1, "c", "consistent", 2, ["y"])]
    df = spark.createDataFrame(rows, "seg string, position int, node string, verdict string, statements long, variables array<string>")
    best = B.shortest_paths(df, "seg", 2).where("rank = 1").collect()
    assert {r["seg"]: [d["taken"] for d in r["decisions"]] for r in best} == {"s": [True, True], "t": [True]}
    wanted = spark.createDataFrame([("b", True), ("c", False)], "node string, taken boolean")
    groups = spark.createDataFrame([(["a", "b"],)], "nodes array<string>")
    found = B.shortest_paths(df, "seg", 5, groups, wanted).orderBy("seg", "rank").collect()
    assert [(r["seg"], [d["taken"] for d in r["decisions"]]) for r in found] == [("s", [False, True]), ("t", [True])]


def test_direction_conflicts_need_every_name(spark):
    rows = [("r", 1, "Calling 'get'", "", None), ("r", 2, "Returning the value 3", "", None), ("r", 3, "Taking true branch", "get > LIMIT", True), ("r", 4, "Taking true branch", "get > other", True), ("r", 5, "Assuming field 'n' is equal to 9", "", None), ("r", 6, "Taking false branch", "n == 9", False), ("q", 1, "Taking true branch", "1 > 2", True)]
    df = spark.createDataFrame(rows, "report_key string, step int, message string, condition string, direction boolean")
    assert [tuple(r) for r in B.direction_conflicts(df, {"LIMIT": "10"}).orderBy("step").collect()] == [("r", 3, "get > LIMIT", True, False), ("r", 6, "n == 9", False, True)]


def test_relevance_is_conservative(spark):
    found = B.relevance(spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "node string"), spark.createDataFrame([("a", False), ("b", True)], "node string, retained boolean"))
    assert {r["node"]: r["relevant"] for r in found.collect()} == {"a": False, "b": True, "c": True}
    assert tuple(B.relevance_summary(found).first()) == (2, 1, 0.333)
    assert tuple(B.relevance_summary(found.limit(0)).first()) == (0, 0, 0.0)


def test_pruning_alignment_and_references(spark):
    nodes, control = spark.createDataFrame([(i,) for i in "abcd"], "id string"), spark.createDataFrame([("a", "b"), ("b", "c")], "source_id string, target_id string")
    assert {r["id"] for r in B.prune_anchored(nodes, control, spark.createDataFrame([("a", "contradictory"), ("d", "consistent")], "id string, verdict string")).collect()} == {"c", "d"}
    blocks = spark.createDataFrame([("f", i, ["call (x)", "y"]) for i in range(6)], "function_name string, block int, statements array<string>")
    known = spark.createDataFrame([("f", i, "z = call(x)" if i < 5 else "other thing") for i in range(6)], "function_name string, block int, expression string")
    r = B.alignment(blocks, known).first()
    assert (round(r["ratio"], 3), r["n_compared"], r["trusted"]) == (0.833, 6, True)
    steps = spark.createDataFrame([("r", 1, "a.c", 5, "event"), ("r", 2, "b.c", 1, "call"), ("r", 3, "a.c", 5, "report"), ("r", 4, "", 0, "event")], "report_key string, step int, file string, line int, kind string")
    assert [tuple(x)[1:] for x in B.references(steps).orderBy("position").collect()] == [(1, "a.c", 5, "event"), (2, "b.c", 1, "call")]


def test_miners_and_opaque_calls(spark):
    lines = spark.createDataFrame([("a.cpp", 1, "  : ready(false) // no"), ("a.cpp", 2, "  this->mode = FAST_MODE;"), ("a.cpp", 3, "if (p->kind == 3) {"), ("a.cpp", 4, "x = y;")], "file string, line int, text string")
    assert [tuple(r)[1:] for r in B.mine_setters(lines).orderBy("line").collect()] == [(1, "initial", "ready", "false"), (2, "initial", "mode", "FAST_MODE"), (3, "guard", "p->kind", "3")]
    nodes = spark.createDataFrame([("f", "n1", "memcpy(&h, b, 4)", "std::memcpy"), ("f", "n2", "use(h.len, h.x)", "use"), ("g", "n3", "h.len", "")], "function_name string, id string, expression string, callee string")
    assert [tuple(r) for r in B.opaque_writes(nodes).collect()] == [("f", "n1", "n2", "h")]


def test_call_return_violations(spark):
    """The branch's demand against what the callee's decisions make it return; unknown sides make no claim."""
    returns = spark.createDataFrame([("a.c", "ok", "branch", 10, False), ("a.c", "ok", "function", 20, True)], "file string, function string, owner string, line int, returned boolean")
    decisions, wanted = [], set()
    cases = [
        # condition, taken, taken inside at line 10, violated as (required, selected, line)
        ("ok(x)", True, True, (True, False, 10)), ("ok(x)", True, False, None), ("!ok(x)", True, False, (False, True, 20)), ("ok(x) || y", True, True, None),
        ("ok(x) && y", False, False, None), ("ok(x)", False, False, (False, True, 20)), ("ok(x) && y", True, True, (True, False, 10)), ("look(x)", True, True, None), ("ok(x)", None, True, None),
    ]
    for path, (condition, taken, inside, violated) in enumerate(cases):
        decisions += [
            (path, 1, "call", "main", "m.c", 5, None, None, "ok"), (path, 2, "control", "Box::ok", "a.c", 10, "n", inside, None), (path, 3, "branch", "main", "m.c", 5, condition, taken, None),
            (path, 4, "call", "main", "m.c", 5, None, None, "ok"),
        ]
        if violated:
            wanted.add((path, "main", 5, "ok", *violated, "a.c"))
    df = spark.createDataFrame(decisions, "path int, position int, kind string, function string, file string, line int, condition string, taken boolean, callee string")
    found = B.call_return_violations(df, returns).collect()
    assert {tuple(r) for r in found} == wanted and len(found) == len(wanted)
    assert B.call_return_violations(df.limit(0), returns).count() == 0


def test_hard_constraints_and_their_first_conflicts(spark):
    from strandline.operators import gates as G

    facts = "report_key int, variable string, operator string, value string, result string"
    checked = [(1, "x", "<=", "0", "VIOLATED"), (1, "x", "<=", "0", "VIOLATED"), (1, "n", "==", "8", "CONSISTENT"), (1, "n", ">", "3", "CONSISTENT"), (1, "q", "==", "MAX", "VIOLATED"), (1, "z", "~", "1", "VIOLATED"), (2, "x", "==", "1", "UNCERTAIN")]
    hard = G.hard_constraints(spark.createDataFrame(checked, facts))
    assert sorted(tuple(r) for r in hard.collect()) == [(1, "n", "==", "8"), (1, "q", "!=", "MAX"), (1, "x", ">", "0")]
    said = [(1, 0, 3, "x", "<", "-5"), (1, 0, 2, "x", "==", "4"), (1, 1, 5, "q", "==", " MAX"), (1, 2, 6, "q", "==", "MIN"), (1, 3, 7, "n", "==", "null"), (1, 3, 8, "n", ">=", "9"), (2, 0, 1, "x", "<", "0"), (1, 4, 9, None, "==", None)]
    found = G.first_conflicts(spark.createDataFrame(said, "report_key int, segment int, event int, variable string, operator string, value string"), hard).collect()
    assert sorted((r["segment"], r["event"], r["hard_operator"], r["hard_value"]) for r in found) == [(0, 3, ">", "0"), (1, 5, "!=", "MAX"), (3, 7, "==", "8")]
