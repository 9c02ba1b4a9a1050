"""Resolution ladders against plain loops."""

import random

from strandline.operators import resolution as R

TREE = ["/src/p/a/io.cpp", "/src/p/b/io.cpp", "/src/p/b/sub/io.cpp", "/src/p/main.c", "/src/p/p/impl/x.h", "/else/base/q/y.h", "/src/p/only.h", "/else/a/io.cpp"]


def brute_file(raw, tree, root, prefixes, bases, embedded):
    text = (raw or "").strip()
    clean = lambda t: [p for p in t.replace("\\", "/").split("/") if p not in ("", ".")]
    if not text:
        return "unresolved", None, 0
    if text.startswith("/") and text in tree:
        return "direct", text, 0

    def trimmed(rest, folder):
        parts = clean(rest)
        return next((f for i in range(len(parts)) if (f := folder + "/" + "/".join(parts[i:])) in tree), None)

    for p in sorted(prefixes, key=len, reverse=True):
        if text.startswith(p) and (hit := trimmed(text[len(p):], root)):
            return "build-prefix", hit, 0
    if not text.startswith("/"):
        for b in [root, *bases]:
            if hit := trimmed(text, b):
                return "relative", hit, 0
    if hit := trimmed(text, root):
        return "suffix", hit, 0
    named = sorted(f for f in tree if f.split("/")[-1] == (clean(text) or [""])[-1])
    if named:
        return "basename", named[0], len(named)
    return ("embedded" if raw in embedded else "unresolved"), None, 0


def test_every_rung_of_the_file_ladder(spark):
    asked = ["/src/p/a/io.cpp", "/build/p/a/io.cpp", "/build/p/p/b/sub/io.cpp", "a/io.cpp", "./main.c", "q/y.h", "/other/x/b/io.cpp", "/usr/include/x.h", "/usr/io.cpp", "gone.c", "gone.h", "", None, " ", "/",
             "b\\io.cpp", "/build", "/build/pmain.c", "deep/q/y.h", "main.c", "/x/p/impl/x.h"]
    prefixes, bases, embedded = ["/build", "/build/p"], ["/else/base"], ["gone.c"]
    frame = lambda rows, name: spark.createDataFrame([(r,) for r in rows], f"{name} string")
    found = {r["reported"]: (r["strategy"], r["local"], r["rivals"]) for r in R.resolve_files(frame(asked + asked[:3], "reported"), frame(TREE, "local"), "/src/p", prefixes, bases, frame(embedded, "reported")).collect()}
    wanted = {a: brute_file(a, set(TREE), "/src/p", prefixes, bases, embedded) for a in asked}
    assert found == wanted and {s for s, _, _ in found.values()} == {*R.STRATEGIES, "embedded", "unresolved"}
    assert R.resolve_files(frame([], "reported"), frame(TREE, "local"), "/src/p").count() == 0


def test_random_paths_equal_a_plain_ladder(spark):
    rng = random.Random(2)
    path = lambda n: "/".join(rng.choice("abc") for _ in range(n))
    tree = {("/r/" if rng.random() < 0.8 else "/o/") + path(rng.randrange(1, 5)) for _ in range(60)}
    asked = {rng.choice(("", "/", "/w/", "/w/v/", "/r/", "./")) + path(rng.randrange(1, 7)) for _ in range(300)}
    frame = lambda rows, name: spark.createDataFrame([(r,) for r in sorted(rows)], f"{name} string")
    found = {r["reported"]: (r["strategy"], r["local"], r["rivals"]) for r in R.resolve_files(frame(asked, "reported"), frame(tree, "local"), "/r", ["/w", "/w/v"], ["/o"]).collect()}
    assert found == {a: brute_file(a, tree, "/r", ["/w", "/w/v"], ["/o"], []) for a in asked}


def test_function_names_climb_their_ladder(spark):
    known = [("ns::Sock::setAddress", 0), ("ns::Sock::setAddr", 1), ("free", 2), ("other::setAddr", 3), ("heap::push", 4), ("a::b::c", 5)]
    asked = [("free", None), ("setAddr", None), ("Sock::setAddr", None), ("b::c", "z"), ("void ns2::X::setAddr(const T<int, U<long>> &)", None), ("template<> inline T *push<CMax<float, long>>(size_t)", None),
             ("lost", "main"), ("ost", "main"), ("lost", None), ("setAdd", None), (None, "main"), ("", "main")]
    calls = [("main", "q::lostly", 0), ("main", "q::lost", 1), ("main", "lost", 2)]
    found = R.resolve_functions(spark.createDataFrame([(i, n, c) for i, (n, c) in enumerate(asked)], "ask int, name string, caller string"),
        spark.createDataFrame(known, "name string, ordinal int"), spark.createDataFrame(calls, "caller string, callee string, ordinal int"))
    said = {r["ask"]: (r["strategy"], r["target"]) for r in found.collect()}
    assert [said[i] for i in range(len(asked))] == [
        ("exact", "free"), ("suffix", "ns::Sock::setAddr"), ("suffix", "ns::Sock::setAddr"), ("suffix", "a::b::c"), ("method", "ns::Sock::setAddr"), ("method", "heap::push"),
        ("callee", "q::lost"), ("mention", "q::lostly"), ("unresolved", None), ("unresolved", None), ("unresolved", None), ("unresolved", None)]


def test_the_nearest_definition_is_picked(spark):
    rng = random.Random(5)
    files = [f"/{a}/{b}.c" for a in "xyz" for b in "pq"]
    definitions = [(rng.choice("fgh"), rng.choice(files), i, i, i + 3) for i in range(14)]
    asked = [(i, rng.choice(("f", "ns::g", "h", "nope")), rng.choice([*files, "/x", "/y", None, "/w/p.c"])) for i in range(60)]
    found = {r["ask"]: (r["tier"], r["file"], r["first_line"]) for r in R.pick_definitions(spark.createDataFrame(asked, "ask int, name string, hint string"), spark.createDataFrame(definitions, "name string, file string, ordinal int, first_line int, last_line int")).collect()}
    wanted = {}
    for i, name, hint in asked:
        own = [d for d in definitions if d[0] == name.split("::")[-1]]
        if not own:
            continue
        tiers = [("file", [d for d in own if d[1] == hint]), ("folder", [d for d in own if hint is not None and d[1].rsplit("/", 1)[0] == hint]), ("folder", [d for d in own if hint is not None and d[1].rsplit("/", 1)[0] == hint.rsplit("/", 1)[0]]), ("first", own)]
        tier, best = next((t, b[0]) for t, b in tiers if b)
        wanted[i] = (tier, best[1], best[3])
    assert found == wanted and len({t for t, _, _ in found.values()}) == 3


def test_events_are_placed_by_class_line_and_bug_file(spark):
    tree = ["/r/src/Store.cc", "/r/lib/Store.cpp", "/r/lib/bug.c", "/r/Disk.c", "/r/lib/h.h"]
    events = [
        ("r1", 0, 5, "Calling 'Store::put'", None), ("r1", 1, 72, "x is null", None), ("r1", 2, 3, "own file", "/r/lib/h.h"), ("r1", 3, 900, "nowhere", None), ("r1", 4, 5, "Calling 'free'", None),
        ("r1", 5, 8, "Calling 'Disk::sync'", "/r/lib/bug.c"), ("r1", 6, 12, "by what line 40 made known", None), ("r1", 7, 40, "elsewhere", None), ("r2", 0, 72, "", None), ("r2", 1, 0, "Calling 'Gone::x'", None),
    ]
    frame = spark.createDataFrame
    events = frame(events, "report string, event int, line int, description string, file string")
    reports = frame([("r1", "/r/lib/bug.c"), ("r2", None)], "report string, bug_file string")
    lines = frame([("/z/z.c", 72, 0), ("/r/lib/h.h", 72, 1), ("/r/lib/Store.cpp", 72, 2), ("/y.c", 12, 3), ("/w.c", 40, 4), ("/w.c", 12, 5), ("/v.c", 5, 6)], "file string, line int, ordinal int")
    classes = R.class_files(events, reports, frame([(t,) for t in tree], "local string"), "/r")
    assert {(r["report"], r["class"], r["file"]) for r in classes.collect()} == {("r1", "Store", "/r/lib/Store.cpp"), ("r1", "Disk", "/r/Disk.c")}
    found = {(r["report"], r["event"]): (r["file"], r["how"]) for r in R.event_files(events, reports, lines, classes).collect()}
    assert found == {
        ("r1", 0): ("/r/lib/Store.cpp", "class"), ("r1", 1): ("/r/lib/h.h", "line"), ("r1", 2): ("/r/lib/h.h", "own"), ("r1", 3): ("/r/lib/bug.c", "bug"), ("r1", 4): ("/v.c", "line"),
        ("r1", 5): ("/r/lib/bug.c", "own"), ("r1", 6): ("/y.c", "line"), ("r1", 7): ("/w.c", "line"), ("r2", 0): ("/z/z.c", "line"), ("r2", 1): (None, "bug"),
    }


def test_a_line_with_many_nodes_counts_once_and_the_first_file_of_a_name_wins(spark):
    """Thirty classes with two files of their name each on the asked line: the one whose node comes first, in every case."""
    frame = spark.createDataFrame
    events = [("r", i, 7, f"Calling 'C{i}::go'", None) for i in range(30)] + [("r", 100 + 2 * i + k, 1, "own", f"/{'ab'[k]}/C{i}.{'cc' if k else 'cpp'}") for i in range(30) for k in (0, 1)]
    first = lambda i: i % 2
    lines = [(f"/{'ab'[k]}/C{i}.{'cc' if k else 'cpp'}", 7, 10 * i + (k != first(i)) + 1000 * n) for i in range(30) for k in (0, 1) for n in range(20)]
    found = R.event_files(frame(events, "report string, event int, line int, description string, file string"), frame([], "report string, bug_file string"), frame(lines, "file string, line int, ordinal int"), frame([], "report string, class string, file string"))
    said = {r["event"]: (r["file"], r["how"]) for r in found.collect()}
    assert len(said) == 90 and all(said[i] == (f"/{'ab'[first(i)]}/C{i}.{'cc' if first(i) else 'cpp'}", "line") for i in range(30))
