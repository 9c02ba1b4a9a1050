"""Slices over calls against a search that carries its stack of calls."""

import random

import pytest

from strandline.operators import slices as S


def a_program(seed, functions=4):
    """Small functions: each has two parameters, a return, some nodes between, and calls of others (circles too)."""
    rng = random.Random(seed)
    names = [f"f{i}" for i in range(functions)]
    data, control, calls, formals, returns, defines = [], [], [], [], [], []
    for f in names:
        nodes = [f"n{i}" for i in range(6)]
        for p in (0, 1):
            formals.append((f, p, f"p{p}"))
            defines.append((f, f"p{p}", f"v{p}"))
        for i, n in enumerate(nodes):
            defines.append((f, n, f"w{i}"))
            for source, variable in rng.sample([*[(m, f"w{j}") for j, m in enumerate(nodes[:i])], ("p0", "v0"), ("p1", "v1")], 1 if rng.random() < 0.8 else 2):
                data.append((f, source, n, variable))
            if i and rng.random() < 0.2:
                control.append((f, nodes[rng.randrange(i)], n))
            if rng.random() < 0.35:
                g = rng.choice([*names, "outside"])
                into = [d for d in data if d[0] == f and d[2] == n]
                for p in (0, 1):
                    variable = rng.choice([*[d[3] for d in into], rng.choice(["w0", "v1", "?"])])
                    calls.append((f, n, g, p, variable))
        returns += [(f, n) for n in rng.sample(nodes, 1)]
    return names, data, control, calls, formals, returns, defines


def brute_slice(seed, data, control, calls, formals, returns, defines, depth=7):
    places = {(f, n): p for f, p, n in formals}
    known = {(f, p) for f, p, _ in formals}
    passed = {}
    for f, c, g, p, v in calls:
        nodes = {s for h, s, d, x in data if h == f and d == c and x == v} or {n for h, n, x in defines if h == f and x == v}
        passed[f, c, g, p] = set() if v in ("", "?") else nodes

    def inside(f, n):
        for h, s, d, v in data:
            if (h, d) == (f, n):
                positions = [(g, p) for a, c, g, p, x in calls if (a, c, x) == (f, n, v)]
                if not positions or not all(q in known for q in positions):
                    yield s
        for h, s, d in control:
            if (h, d) == (f, n):
                yield s

    start = (*seed, ())
    seen, todo = {start}, [start]
    while todo:
        f, n, stack = todo.pop()
        steps = [(f, m, stack) for m in inside(f, n)]
        if len(stack) < depth:
            steps += [(g, r, (*stack, (f, n))) for a, c, g, _, _ in calls if (a, c) == (f, n) for h, r in returns if h == g]
        if (f, n) in places:
            for (a, c, g, p), nodes in passed.items():
                if g == f and p == places[f, n] and (not stack or stack[-1] == (a, c)):
                    below = stack[:-1] if stack else ()
                    steps += [(a, m, below) for m in nodes] + [(a, s, below) for h, s, d in control if (h, d) == (a, c)]
        for s in steps:
            if s not in seen:
                seen.add(s)
                todo.append(s)
    return {s[:2] for s in seen}


def frames(spark, data, control, calls, formals, returns, defines):
    make = spark.createDataFrame
    return dict(
        data=make(data, "function string, src string, dst string, variable string"), control=make(control, "function string, src string, dst string"),
        calls=make(calls, "function string, call string, callee string, position int, variable string"), formals=make(formals, "function string, position int, node string"),
        returns=make(returns, "function string, node string"), defines=make(defines, "function string, node string, variable string"),
    )


@pytest.mark.parametrize("seed", range(5))
def test_slices_equal_a_search_with_a_stack(spark, seed):
    _, *program = a_program(seed)
    rng = random.Random(seed)
    start = (f"f{rng.randrange(4)}", rng.choice(["n3", "n4", "n5"]))
    found = S.context_slice(spark.createDataFrame([start], "function string, node string"), **frames(spark, *program))
    assert {tuple(r) for r in found.collect()} == brute_slice(start, *program)


def test_a_return_goes_back_to_its_own_call_only(spark):
    """id(x) is called at two places; the slice of one call's value has nothing of the other's argument."""
    data = [("id", "p", "r", "x"), ("main", "a", "c1", "a"), ("main", "b", "c2", "b"), ("main", "c1", "use", "y"), ("first", "fp", "fr", "u")]
    calls = [("main", "c1", "id", 0, "a"), ("main", "c2", "id", 0, "b")]
    program = frames(spark, data, [("main", "if", "c1")], calls, [("id", 0, "p"), ("first", 0, "fp")], [("id", "r")], [("main", "a", "a"), ("main", "b", "b"), ("id", "p", "x")])
    said = lambda f, n: {tuple(r) for r in S.context_slice(spark.createDataFrame([(f, n)], "function string, node string"), **program).collect()}
    assert said("main", "use") == {("main", "use"), ("main", "c1"), ("main", "a"), ("main", "if"), ("id", "r"), ("id", "p")}
    assert said("id", "r") == {("id", "r"), ("id", "p"), ("main", "a"), ("main", "b"), ("main", "if")}


def test_an_argument_that_a_callee_ignores_stays_out(spark):
    data = [("one", "p0", "r", "x"), ("main", "a", "c", "a"), ("main", "b", "c", "b"), ("main", "a", "d", "a"), ("main", "b", "d", "b")]
    calls = [("main", "c", "one", 0, "a"), ("main", "c", "one", 1, "b"), ("main", "d", "unknown", 0, "a"), ("main", "d", "unknown", 1, "b")]
    program = frames(spark, data, [], calls, [("one", 0, "p0"), ("one", 1, "p1")], [("one", "r")], [("main", "a", "a"), ("main", "b", "b")])
    said = lambda n: {r["node"] for r in S.context_slice(spark.createDataFrame([("main", n)], "function string, node string"), **program).where("function = 'main'").collect()}
    assert said("c") == {"c", "a"} and said("d") == {"d", "a", "b"}


def test_the_path_has_one_caller(spark):
    make = spark.createDataFrame
    data = make([("callee", "p", "use", "x"), ("caller", "d0", "d1", "k"), ("other", "o", "oc", "k")], "function string, src string, dst string, variable string")
    control = make([("callee", "q", "use"), ("callee", "t", "use")], "function string, src string, dst string")
    calls = make([("caller", "c9", "callee", 0, "k", 9), ("caller", "c3", "callee", 0, "k", 3), ("other", "oc", "callee", 0, "k", 1)], "function string, call string, callee string, position int, variable string, ordinal int")
    formals = make([("callee", 0, "p")], "function string, position int, node string")
    defines = make([("caller", "d1", "k"), ("other", "o", "k")], "function string, node string, variable string")
    refused = make([("callee", "q")], "function string, node string")
    found = S.path_slice(make([("callee", "use")], "function string, node string"), data, control, make([("callee", "caller")], "function string, caller string"), calls, formals, defines, refused)
    assert {tuple(r) for r in found.collect()} == {("callee", "use"), ("callee", "p"), ("callee", "t"), ("caller", "c3"), ("caller", "d1"), ("caller", "d0")}


def test_chains_of_callers_end_in_circles(spark):
    callers = [("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("y", "y"), ("z", None)]
    found = {tuple(r) for r in S.caller_chain(spark.createDataFrame(callers, "function string, caller string")).select("function", "callee", "caller", "steps").collect()}
    assert found == {("a", "a", "b", 1), ("a", "b", "c", 2), ("a", "c", "a", 3), ("b", "b", "c", 1), ("b", "c", "a", 2), ("b", "a", "b", 3), ("c", "c", "a", 1), ("c", "a", "b", 2), ("c", "b", "c", 3),
                     ("x", "x", "a", 1), ("x", "a", "b", 2), ("x", "b", "c", 3), ("x", "c", "a", 4)}


def test_fields_climb_to_the_class_or_the_constructor(spark):
    make = spark.createDataFrame
    uses = make([("n::C::leaf", "u", "[this].f"), ("n::C::leaf", "w", "[this].own"), ("n::C::leaf", "v", "plain")], "function string, node string, variable string")
    defines = make([("n::C::mid", "m", "[this].f"), ("n::C::leaf", "l", "[this].own"), ("n::C::C", "k", "[this].f"), ("n::D::top", "d", "[this].f"), ("n::C::other", "o", "[this].f")], "function string, node string, variable string")
    chain = S.caller_chain(make([("n::C::leaf", "n::C::mid"), ("n::C::mid", "n::D::top")], "function string, caller string"))
    sites = make([("n::C::mid", "c1", "n::C::leaf", "this->leaf(1)"), ("n::D::top", "c2", "n::C::mid", "if (obj.mid(x))")], "function string, call string, callee string, expression string")
    made = make([("n::D::top", "new", "obj", "n::C::C"), ("n::D::top", "bad", "obj", "n::E::E")], "function string, node string, object string, constructor string")
    found = {tuple(r) for r in S.field_climbs(uses, defines, chain, sites, made).collect()}
    assert found == {("n::C::leaf", "u", "n::C::mid", "m"), ("n::C::leaf", "u", "n::C::C", "k"), ("n::C::leaf", "u", "n::D::top", "new")}
    other = sites.replace("this->leaf(1)", "that->leaf(1)")
    assert ("n::C::leaf", "u", "n::C::mid", "m") not in {tuple(r) for r in S.field_climbs(uses, defines, chain, other, made).collect()}


def test_a_long_function_is_crossed_in_a_few_rounds(spark, monkeypatch):
    from strandline.operators import graph

    settled, settle = [], graph.settle
    monkeypatch.setattr(graph, "settle", lambda df: settled.append(1) or settle(df))
    frame = spark.createDataFrame
    data = frame([("f", f"n{i}", f"n{i + 1}", f"v{i}") for i in range(25)], "function string, src string, dst string, variable string")
    empty = lambda schema: frame([], schema)
    found = S.context_slice(frame([("f", "n25")], "function string, node string"), data, empty("function string, src string, dst string"), empty("function string, call string, callee string, position int, variable string"),
        empty("function string, position int, node string"), frame([("f", "n25")], "function string, node string"), empty("function string, node string, variable string"))
    assert {r["node"] for r in found.collect()} == {f"n{i}" for i in range(26)} and len(settled) < 25


def test_functions_that_nothing_reaches_are_not_crossed(spark, monkeypatch):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    crossed, own = set(), S.shortcuts
    monkeypatch.setattr(S, "shortcuts", lambda edges, *a: (crossed.update(r["function"] for r in edges.collect()), own(edges, *a))[1])
    data = frame([(f, "p", "n1", "v") for f in ("main", "g", "idle")] + [(f, "n1", "n2", "w") for f in ("main", "g", "idle")], "function string, src string, dst string, variable string")
    control = frame([], "function string, src string, dst string")
    calls = frame([("main", "n1", "g", 0, "v"), ("idle", "n1", "g", 0, "v")], "function string, call string, callee string, position int, variable string")
    formals = frame([(f, 0, "p") for f in ("main", "g", "idle")], "function string, position int, node string")
    returns = frame([(f, "n2") for f in ("main", "g", "idle")], "function string, node string")
    defines = frame([(f, "p", "v") for f in ("main", "g", "idle")], "function string, node string, variable string")
    found = {tuple(r) for r in S.context_slice(frame([("main", "n2")], "function string, node string"), data, control, calls, formals, returns, defines).collect()}
    assert found == {(f, n) for f in ("main", "g") for n in ("n2", "n1", "p")}
    assert crossed == {"main", "g"}
