"""Branch sources, branch trees and conditions against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from strandline.operators import branch_trees as B
from strandline.operators import conditions as C

NODE = "function string, node string, ordinal int, kind string, line int, expression string, block int, callee string"
KINDS = ["binary_op", "unary_op", "call_expr", "decl", "event", "assign"]


def a_graph(seed, functions=7, most=14, lines=30):
    rng = random.Random(seed)
    names = [f"f{i}" for i in range(functions)]
    nodes, control = [], []
    for f in names:
        for i in range(rng.randrange(most)):
            callee = rng.choice([*names, "unknown"]) if rng.random() < 0.35 else None
            nodes.append((f, f"n{i:02}", i, rng.choice(KINDS), rng.randrange(1, lines), "x" * rng.randrange(4), rng.randrange(4), callee))
            if rng.random() < 0.5:
                control += [(f, f"n{i:02}")] * rng.choice((1, 2))
    return rng, names, nodes, control


def brute_sources(nodes, control):
    out = set()
    for f, source in set(control):
        node = next((n for n in nodes if n[0] == f and n[1] == source), None)
        if node is None:
            continue
        if node[3] in B.PREDICATE_KINDS:
            out.add((f, source))
            continue
        near = [n for n in nodes if n[0] == f and n[3] in B.PREDICATE_KINDS and abs(n[4] - node[4]) <= 5]
        if near:
            out.add((f, min(near, key=lambda n: (abs(n[4] - node[4]), -len(n[5]), -n[4], n[2]))[1]))
    return out


@pytest.mark.parametrize(("seed", "block_lines"), [(1, 4096), (2, 12), (3, 7)])
def test_sources_are_the_nearest_predicates(spark, seed, block_lines):
    _, _, nodes, control = a_graph(seed, functions=12, most=20)
    control.append(("f0", "missing"))
    found = B.branch_sources(spark.createDataFrame(nodes, NODE), spark.createDataFrame(control, "function string, source string"), block_lines=block_lines)
    assert {tuple(r) for r in found.collect()} == brute_sources(nodes, control)


def brute_trees(segments, nodes, own, facts, on_path, separate):
    """The tree by plain recursion: lists of (name, function, line, depth, callee, children)."""
    by = {n[:2]: n for n in nodes}

    def on(f, line, free=False):
        return free or f not in on_path or line in on_path[f]

    def calls(f):
        seen = []
        for n in sorted((n for n in nodes if n[0] == f and n[7]), key=lambda n: n[2]):
            if (n[7], n[4]) not in [c[:2] for c in seen]:
                seen.append((n[7], n[4], n[6]))
        return seen

    def predicates(f, free=False):
        return [by[f, n] for g, n in sorted(own) if g == f and on(f, by[f, n][4], free)]

    def node(f, callee, line, depth, stack):
        if callee not in facts:
            return None
        project, retained = facts[callee]
        mode = "none" if callee in stack else "shallow" if not project else "none" if depth + 1 > 1 and not retained else "full"
        row = [f"callee_{f}_{callee}_L{line}", f, line, depth, callee, []]
        if mode == "none":
            return row if any(g == callee for g, _ in own) or calls(callee) else None
        row[5] = branches(callee, depth + 1, mode == "full", [*stack, callee])
        return row if row[5] else None

    def branches(f, depth, nested, stack):
        rows = [[f"pdg_{f}_{n[1]}", f, n[4], depth, None, []] for n in predicates(f)]
        if nested and depth < 3:
            for callee, line, block in calls(f):
                if callee == f or not on(f, line) or (row := node(f, callee, line, depth, stack)) is None:
                    continue
                host = next((r for r, n in zip(rows, predicates(f)) if block > 0 and n[6] == block), None)
                if host is not None:
                    host[5] += row[5]
                else:
                    rows.append(row)
        return rows

    out = []

    def told(segment, row, parent, path):
        here = f"{path}>{row[0]}"
        out.append((segment, here, parent, row[0], row[1], row[2], row[3], row[4]))
        for child in row[5]:
            told(segment, child, here, here)

    for segment, position, f, low, high in segments:
        free = f in on_path and high not in on_path[f] and high > 0
        inside = lambda line: low <= line <= high and (position == 0 or line != low)
        for n in predicates(f, free):
            if inside(n[4]):
                told(segment, [f"pdg_{f}_{n[1]}", f, n[4], 0, None, []], None, segment)
        for callee, line, _ in calls(f):
            if inside(line) and on(f, line, free) and (segment, callee) not in separate and (row := node(f, callee, line, 0, [])):
                told(segment, row, None, segment)
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(6))
def test_trees_equal_plain_recursion(spark, seed):
    rng, names, nodes, control = a_graph(seed)
    own = brute_sources(nodes, control)
    facts = {f: (rng.random() < 0.8, rng.random() < 0.7) for f in names}
    on_path = {f: {x for x in range(30) if rng.random() < 0.8} for f in rng.sample(names, 3)}
    segments = [(f"s{i}", rng.randrange(2), rng.choice(names), (low := rng.randrange(1, 15)), low + rng.randrange(20)) for i in range(8)]
    separate = {(s[0], rng.choice(names)) for s in segments[:3]}
    frame = spark.createDataFrame
    found = B.branch_trees(
        frame(segments, "segment string, position int, function string, low int, high int"), frame(nodes, NODE), frame(sorted(own), "function string, node string"),
        frame([(f, *x) for f, x in facts.items()], "function string, project boolean, retained boolean"), frame([(f, f) for f in names], "callee string, target string"),
        frame([(f, x) for f, xs in on_path.items() for x in xs], "function string, line int"), frame(sorted(separate), "segment string, callee string"),
    )
    rows = sorted(((r["segment"], r["path"], r["parent"], r["name"], r["function"], r["line"], r["depth"], r["callee"]) for r in found.collect()), key=repr)
    wanted = brute_trees(segments, nodes, own, facts, on_path, separate)
    assert rows == wanted and wanted


def test_recursion_ends_and_leaves_keep_their_row(spark):
    nodes = [
        ("main", "c", 0, "call_expr", 5, "go()", 1, "go"), ("go", "p", 0, "binary_op", 3, "n > 0", 1, None), ("go", "c", 1, "call_expr", 4, "back()", 2, "back"),
        ("back", "p", 0, "binary_op", 3, "m", 1, None), ("back", "c", 1, "call_expr", 9, "go()", 2, "go"), ("back", "q", 2, "call_expr", 8, "silent()", 2, "silent"),
        ("back", "e", 3, "call_expr", 7, "env()", 3, "env"), ("env", "p", 0, "binary_op", 1, "z", 0, None), ("env", "c", 1, "call_expr", 2, "go()", 0, "go"),
    ]
    own = [("go", "p"), ("back", "p"), ("env", "p")]
    frame = spark.createDataFrame
    functions = frame([(f, f != "env", True) for f in ("main", "go", "back", "env", "silent")], "function string, project boolean, retained boolean")
    names = frame([(f, f) for f in ("main", "go", "back", "env", "silent")], "callee string, target string")
    found = {r["name"]: r for r in B.branch_trees(frame([("s", 0, "main", 1, 9)], "segment string, position int, function string, low int, high int"), frame(nodes, NODE), frame(own, "function string, node string"), functions, names).collect()}
    assert set(found) == {"callee_main_go_L5", "pdg_go_p", "callee_go_back_L4", "pdg_back_p", "callee_back_go_L9", "callee_back_env_L7", "pdg_env_p"}
    assert found["callee_back_go_L9"]["parent"] == found["callee_go_back_L4"]["path"] and found["pdg_env_p"]["depth"] == 3


def test_blocks_and_ranges(spark):
    _, _, nodes, _ = a_graph(11)
    df = spark.createDataFrame(nodes, NODE)
    index = {(r["function"], r["block"]): r for r in B.block_index(df).collect()}
    for key in {(n[0], n[6]) for n in nodes if n[6] > 0}:
        assert index[key]["lines"] == sorted({n[4] for n in nodes if (n[0], n[6]) == key})
        calls = list(dict.fromkeys((n[7], n[4]) for n in nodes if (n[0], n[6]) == key and n[7]))
        assert [(c["callee"], c["line"]) for c in index[key]["calls"] or []] == calls
    ranges = spark.createDataFrame([("f1", 3, 12), ("f2", 20, 4)], "function string, low int, high int")
    found = {(r["function"], r["callee"], r["line"]) for r in B.calls_in_ranges(ranges, df).collect()}
    assert found == {(n[0], n[7], n[4]) for n in nodes if n[7] and n[0] == "f1" and 3 <= n[4] <= 12}


# ---- conditions


def conditions(spark, blocks, terminators, function="f"):
    statements = spark.createDataFrame([(function, b, i, t) for b, ts in blocks.items() for i, t in enumerate(ts)], "function string, block string, ordinal int, text string")
    asked = spark.createDataFrame([(function, b, t) for b, t in terminators.items()], "function string, block string, text string")
    return {r["block"]: (r["condition"], r["resolved"]) for r in C.resolved_conditions(asked, statements).collect()}


def test_references_within_and_across_blocks(spark):
    blocks = {
        "B6": ["[B6.1] (ImplicitCastExpr) o->ready", "[B6.2] (ImplicitCastExpr) o->msg", "[B6.11] (IntegerLiteral) 1", "[B6.13] (IntegerLiteral) 0", "[B6.14] [B6.2] == [B6.13]", "[B6.15] [B6.14] != [B6.11]"],
        "B7": ["[B7.4] (ImplicitCastExpr) o->err", "[B7.5] (IntegerLiteral) 0", "[B7.6] (BinaryOperator) [B7.4] < [B7.5]"],
        "B8": ["[B8.6] (ImplicitCastExpr) o->msg"],
        "B9": [], "B5": [],
    }
    found = conditions(spark, blocks, {"B6": "if [B6.15]", "B7": "while [B6.1] || ([B8.6] && [B7.6])", "B8": "if [B99.99]", "B9": "return [B6.1]", "B5": "switch [B6.1]"})
    assert found == {"B6": ("[B6.15]", "o->msg == 0 != 1"), "B7": ("[B6.1] || ([B8.6] && [B7.6])", "o->ready || (o->msg && o->err < 0)"), "B8": ("[B99.99]", "[B99.99]")}


def test_implicit_operands_follow_the_order_of_lines(spark):
    blocks = {
        "B7": ["ctx", "[B7.1] (ImplicitCastExpr, LValueToRValue, struct c *)", "[B7.2] ->error", "[B7.3] (ImplicitCastExpr, IntegralCast)", "0", "[B7.4] != [B7.5]"],
        "B50": ["[B50.1] (ImplicitCastExpr) a", "[B50.3] (ImplicitCastExpr)", "other", "[B50.5] (ImplicitCastExpr)", "[B50.6] .size"],
        "B3": ["[B3.1] (BinaryOperator) [B50.6] + [B3.9]", "&skip", "(skip too)", "last"],
    }
    found = conditions(spark, blocks, {"B7": "if [B7.4] != [B7.5]", "B50": "for != [B7.5]", "B3": "if [B3.1] (BinaryOperator) r >= 0"})
    assert found["B7"] == ("[B7.4] != [B7.5]", "ctx->error != 0")
    assert found["B50"] == ("!= [B7.5]", "other.size != 0")
    assert found["B3"] == ("r >= 0", "r >= 0")
    assert conditions(spark, blocks, {"B3": "if [B3.1] (BinaryOperator)", "B7": None})["B3"] == ("[B3.1]", "other.size + last")


def test_cycles_and_deep_chains_end(spark):
    deep = [f"[B1.{i}] ([B1.{i - 1}])" if i else "[B1.0] x" for i in range(30)]
    found = conditions(spark, {"B1": deep, "B2": ["[B2.1] [B2.2] + 1", "[B2.2] [B2.1] * 2"]}, {"B1": "if [B1.29]", "B2": "if [B2.1]"})
    assert found["B1"][1] == "(" * 10 + "[B1.19]" + ")" * 10
    assert found["B2"][1].count("+ 1") == 5 and re.search(C.REFERENCE, found["B2"][1])


@pytest.mark.parametrize("seed", range(3))
def test_shared_elements_equal_recursive_substitution(spark, seed):
    rng = random.Random(seed)
    blocks = {}
    for b in range(4):
        blocks[f"B{b}"] = [f"[B{b}.{i}] " + rng.choice(["v%d" % i, "[B{0}.{1}] + [B{2}.{3}]", "![B{2}.{3}]", "f([B{0}.{1}], [B{0}.{1}])"]).format(rng.randrange(b + 1), rng.randrange(4), rng.randrange(b + 1), rng.randrange(4)) for i in range(4)]
    rule = {line[1 : line.index("]")]: line[line.index("]") + 2 :] for lines in blocks.values() for line in lines}

    def told(key, left):
        if "[" not in rule[key]:
            return rule[key]
        return f"[{key}]" if left == 0 else re.sub(r"\[(\w+\.\d+)\]", lambda m: told(m[1], left - 1), rule[key])

    statements = spark.createDataFrame([("f", b, i, t) for b, ts in blocks.items() for i, t in enumerate(ts)], "function string, block string, ordinal int, text string")
    found = {r["key"]: r["text"] for r in C.resolved_elements(statements, rounds=5).collect()}
    assert found == {k: told(k, 5) for k in rule}


def test_levels_carry_numbers_and_lines_are_numbered_once(spark, monkeypatch):
    from strandline.plans import branch_plans

    settled, settle = [], B.settle
    monkeypatch.setattr(B, "settle", lambda df: settled.append(df.dtypes) or settle(df))
    trees = branch_plans.branch_trees(spark, "/root/testdata/sf0.001")
    levels = [dict(d) for d in settled if "stack" in dict(d)]
    assert len(levels) == B.MOST_DEPTH and all(d["id"] == d["outer"] == "bigint" and not {"path", "name"} & d.keys() for d in levels)
    assert "lineitem" not in trees._jdf.queryExecution().optimizedPlan().toString() and not any("lineitem" in f for f in trees.inputFiles())
    nodes = spark.createDataFrame([("f", f"n{i}", i, "binary_op" if i != 40 else "decl", 100 + i % 41, "x" * (i % 5), 0, None) for i in range(60)], "function string, node string, ordinal long, kind string, line long, expression string, block long, callee string")
    control = nodes.select("function", F.col("node").alias("source"))
    whole = {tuple(r) for r in B.branch_sources(nodes, control).collect()}
    assert all({tuple(r) for r in B.branch_sources(nodes, control, block_lines=n).collect()} == whole for n in (11, 37))
    assert B.branch_sources(nodes, control)._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1


def test_short_functions_take_no_rounds_over_tables_and_give_the_same_texts(spark, monkeypatch):
    rng, rows = random.Random(5), []
    for f in range(40):
        for b in range(3):
            rows += [(f"f{f}", f"B{b}", 0, None), (f"f{f}", f"B{b}", 1, f"bare{f}")][: rng.randrange(3)]
            for i in range(1, 6):
                ref = lambda: f"[B{rng.randrange(4)}.{rng.randrange(1, 8)}]"
                body = rng.choice(["(DeclRefExpr) v", f"!{ref()}", f"{ref()} + {ref()}", "", "->field", "long" * 3000, f"{ref()} (ImplicitCastExpr)"])
                rows.append((f"f{f}", f"B{b}", 10 + i, f"[B{b}.{i}] {body}"))
    rows += [("twice", "B1", i, f"[B1.1] {t}") for i, t in enumerate("xy")] + [("twice", "B1", 5, "[B1.2] ![B1.1]"), (None, "B1", 0, "[B1.1] z"), (None, "B1", 1, "[B1.2] ![B1.1]")]
    df = spark.createDataFrame(rows, "function string, block string, ordinal int, text string")
    told = lambda held, only: sorted(map(str, C.resolved_elements(df.where(only), 3, held).collect()))
    by_tables = told(0, "true")
    assert told(C.HELD_ROWS, "true") == by_tables and len(by_tables) == 40 * 15 + 5
    monkeypatch.setattr(C, "_rewritten", None)
    assert len(told(C.HELD_ROWS, "function LIKE 'f%'")) == 40 * 15


def test_sources_that_tell_their_kind_and_line_are_not_looked_up(spark):
    nodes = spark.createDataFrame([("f", "d", 0, "decl", 3, "x"), ("f", "p", 1, "binary_op", 5, "x > 1"), ("f", "q", 2, "unary_op", 9, "!x"), ("g", "d", 0, "decl", 1, "y")], "function string, node string, ordinal int, kind string, line int, expression string")
    control = nodes.where("node <> 'p'").selectExpr("function", "node AS source", "kind", "line")
    told, asked = B.branch_sources(nodes, control), B.branch_sources(nodes, control.select("function", "source"))
    joins = lambda df: df._jdf.queryExecution().analyzed().toString().count("Join ")
    assert {tuple(r) for r in told.collect()} == {tuple(r) for r in asked.collect()} == {("f", "p"), ("f", "q")}
    assert joins(told) < joins(asked)
