"""Constant tracing, callee sources and segment selection against plain loops."""

import itertools
import random

import pytest

from strandline.operators import callees, constants, selection


def brute_constants(seeds, edges):
    """Every value that reaches a slot, by plain search."""
    reach = {}
    for s, v in seeds:
        todo, seen = [s], {s}
        while todo:
            x = todo.pop()
            reach.setdefault(x, set()).add(v)
            for a, b in edges:
                if a == x and b is not None and b not in seen:
                    seen.add(b)
                    todo.append(b)
    return {x: ("unknown", None) if None in vs else ("constant", next(iter(vs))) if len(vs) == 1 else ("conflict", None) for x, vs in reach.items()}


@pytest.mark.parametrize("seed", range(4))
def test_states_equal_all_values_that_arrive(spark, seed):
    rng = random.Random(seed)
    slots = [f"s{i}" for i in range(25)]
    edges = [(rng.choice(slots), rng.choice(slots)) for _ in range(28)] + [("s0", None)]
    seeds = [(rng.choice(slots), rng.choice(["1", "1", "2", None] if rng.random() < 0.5 else ["1"])) for _ in range(6)]
    found = constants.trace_constants(spark.createDataFrame(seeds, "slot string, value string"), spark.createDataFrame(edges, "src string, dst string"))
    assert {r["slot"]: (r["state"], r["value"]) for r in found.collect()} == brute_constants(seeds, edges)


def test_arguments_are_traced_through_getters_and_options(spark):
    frame = spark.createDataFrame
    arguments = [
        ("Box::Box", 0, "4"), ("Box::Box", 0, " 4 "), ("Box::Box", 1, "4"), ("Box::Box", 1, "5"), ("Lid::Lid", 0, "box->size()"), ("Lid::Lid", 1, "box.other()"), ("Lid::Lid", 2, 'o->get(PREF_LEN)'), ("Lid::Lid", 3, '"x, y"'),
        ("Lid::Lid", 4, "n + 1"), ("Lid::Lid", 5, "o->get(PREF_NONE)"), ("Hat::Hat", 0, "lid.size2()"), ("Hat::Hat", 1, "4"), ("Hat::Hat", 1, "box->size()"), ("Hat::Hat", 2, None), ("Hat::Hat", 3, "hat.own()"),
    ]
    found = constants.traced_parameters(
        frame(arguments, "callee string, position int, text string"), frame([("Box::Box", 0, "size_"), ("Lid::Lid", 0, "l_"), ("Hat::Hat", 3, "h_")], "callee string, position int, field string"),
        frame([("size", "size_"), ("size2", "l_"), ("own", "h_")], "name string, field string"), frame([("PREF_LEN", "1M")], "name string, value string"))
    said = {(r["callee"][:3], r["position"]): (r["state"], r["value"], r["sites"]) for r in found.collect()}
    assert said == {
        ("Box", 0): ("constant", "4", 2), ("Box", 1): ("conflict", None, 2), ("Lid", 0): ("constant", "4", 1), ("Lid", 1): ("unknown", None, 1), ("Lid", 2): ("constant", "1M", 1), ("Lid", 3): ("constant", '"x, y"', 1),
        ("Lid", 4): ("unknown", None, 1), ("Lid", 5): ("unknown", None, 1), ("Hat", 0): ("constant", "4", 1), ("Hat", 1): ("constant", "4", 2), ("Hat", 2): ("unknown", None, 1), ("Hat", 3): ("unknown", None, 1),
    }


@pytest.mark.parametrize("total", [None, 9])
def test_callee_sources_equal_a_loop_over_the_report(spark, total):
    rng = random.Random(6)
    definitions = [(f"m{i % 5}", f"/{rng.choice('ab')}/f{i}.c", i, (first := rng.randrange(1, 20)), first + rng.randrange(8)) for i in range(9)]
    lines = [(f, n, f"{f} {n}") for f in {d[1] for d in definitions} for n in range(1, 24)]
    events = [(rng.choice(["r", "s"]), i, rng.choice(["m0", "N::m1", "m2", "m7", " m3 ", None, ""]), rng.choice(["/a/x.c", "/b/f1.c", None])) for i in range(24)]
    skipped = [("r", "m2")]
    frame = spark.createDataFrame
    planned = callees.planned_callees(frame(events, "report string, step int, callee string, file string"), frame(definitions, "name string, file string, ordinal int, first_line int, last_line int"),
        frame(skipped, "report string, callee string"), most_functions=3, most_lines=4, total_lines=total)
    found = {(r["report"], r["callee"]): (r["file"], r["first_line"], r["n_lines"], r["cut"], r["body"]) for r in callees.callee_sources(planned, frame(lines, "file string, line int, text string")).collect()}
    wanted = {}
    for report in ("r", "s"):
        ordered, hints, left = [], {}, total
        for r, _, callee, file in events:
            name = (callee or "").strip()
            if r == report and name and name not in ordered and (r, name) not in skipped:
                ordered.append(name)
                hints[name] = file
        for name in ordered[:3]:
            own = [d for d in definitions if d[0] == name.split("::")[-1]]
            hint = hints[name]
            best = next((d for d in own if d[1] == hint), None) or next((d for d in own if hint and d[1].rsplit("/", 1)[0] == hint.rsplit("/", 1)[0]), None) or next(iter(own), None)
            if best is None:
                continue
            n = min(4, best[4] - best[3] + 1)
            if left is not None:
                left -= n
                if left < 0:
                    break
            wanted[report, name] = (best[1], best[3], n, best[4] - best[3] + 1 > n, "\n".join(f"{i + 1}: {best[1]} {best[3] + i}" for i in range(n)))
    assert found == wanted and wanted


@pytest.mark.parametrize("seed", range(40))
def test_selection_equals_exhaustive_search(seed):
    rng = random.Random(seed)
    candidates = [[f"c{i}" for i in range(rng.randrange(1, 5))] for _ in range(rng.randrange(1, 7))]
    everything = [(i, c) for i, cs in enumerate(candidates) for c in cs]
    clashes = {frozenset((rng.choice(everything), rng.choice(everything))) for _ in range(rng.randrange(30))}
    free = next((list(p) for p in itertools.product(*[range(len(c)) for c in candidates]) if not any(c <= {(i, candidates[i][k]) for i, k in enumerate(p)} for c in clashes)), None)
    found, _, ended = selection.first_free_selection(candidates, clashes)
    assert found == free and ended


def test_search_goes_back_past_what_has_no_part_in_a_conflict():
    """The first and last segment clash whatever is between; trying all would take 6 ** 14 selections."""
    candidates = [[f"c{i}" for i in range(6)] for _ in range(16)]
    clashes = {frozenset(((0, f"c{a}"), (15, f"c{b}"))) for a in range(6) for b in range(6) if (a, b) != (5, 3)}
    found, tried, ended = selection.first_free_selection(candidates, clashes)
    assert found == [5, *[0] * 14, 3] and ended and tried < 500
    assert selection.first_free_selection(candidates, clashes | {frozenset(((0, "c5"),))})[0] is None
    assert selection.first_free_selection(candidates, clashes, 20)[2] is False


def test_reports_are_selected_apart(spark):
    candidates = [("a", 1, "x", 1), ("a", 1, "y", 2), ("a", 2, "x", 1), ("a", 2, "x", 1), ("b", 1, "x", 1), ("c", 1, "x", 1), ("c", 2, "z", 3), (None, 1, "n", 1)]
    conflicts = [("a", 1, "x", 2, "x"), ("b", 1, "x", 1, "x"), ("d", 1, "x", 2, "x"), ("c", 9, "x", 2, "z")]
    found = selection.select_segments(spark.createDataFrame(candidates, "report string, segment int, candidate string, rank int"),
        spark.createDataFrame(conflicts, "report string, segment int, candidate string, other_segment int, other_candidate string")).collect()
    assert {(r["report"], r["verdict"], r["segment"], r["candidate"], r["rank"]) for r in found} == {
        ("a", "found", 1, "y", 2), ("a", "found", 2, "x", 1), ("b", "infeasible", None, None, None), ("c", "found", 1, "x", 1), ("c", "found", 2, "z", 3), (None, "found", 1, "n", 1)}


def test_a_candidate_given_twice_counts_by_its_least_rank(spark):
    candidates = [("r", 1, "a", 3), ("r", 1, "a", 1), ("r", 1, "b", 2), (None, 1, "a", 1), (None, 1, "b", 2)]
    conflicts = [(None, 1, "a", 1, "a"), ("gone", 1, "a", 1, "a"), ("r", 2, "x", 1, "a")]
    found = selection.select_segments(spark.createDataFrame(candidates, "report string, segment int, candidate string, rank int"), spark.createDataFrame(conflicts, "report string, segment int, candidate string, other_segment int, other_candidate string"))
    assert {tuple(r)[:5] for r in found.collect()} == {("r", "found", 1, "a", 1), (None, "found", 1, "b", 2)}
