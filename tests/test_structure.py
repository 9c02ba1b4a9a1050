"""Control structure of a small source file and what paths say about it."""

import pytest

from strandline.operators import structure as S

SOURCE = """#define X(a) if (a) {
int Box::size(const char *p, int n) const {  // if (no) {
  if (p == 0 ||
      n > 3 ||
      strcmp(p, ") {") == 0) {
    return 1;
  } else if (n == 2) {
    go();
  } else {
    stop();
  }
  while (n > 0) n--;
  if (n) if (p) return 2; else return 3;
  return 0;
}
static void go() { for (int i = 0; i < 3; i++) { f(i); } }
int broken( { if (x
"""


@pytest.fixture(scope="module")
def controls(spark):
    return S.control_statements(spark.createDataFrame([("a.cpp", SOURCE), ("empty", ""), ("null", None)], "file string, content string")).cache()


def test_statements(controls):
    rows = {(r["line"], r["keyword"], r["condition"]): r for r in controls.collect()}
    assert set(rows) == {(3, "if", 'p == 0 || n > 3 || strcmp(p, ") {") == 0'), (7, "if", "n == 2"), (12, "while", "n > 0"), (13, "if", "n"), (13, "if", "p"), (16, "for", "int i = 0; i < 3; i++")}
    first = next(r for r in rows.values() if r["line"] == 3)
    assert (first["body_start"], first["body_end"]) == (5, 7) and [tuple(x) for x in first["else_ranges"]] == [(7, 9), (9, 11)]
    assert [(o["line"], o["joined_by"]) for o in first["operands"]] == [(3, ""), (4, "||"), (5, "||")]


def test_functions(spark):
    found = S.function_ranges(spark.createDataFrame([("a.cpp", SOURCE)], "file string, content string")).collect()
    assert [tuple(r)[1:] for r in found] == [("Box::size", 2, 2, 15), ("go", 16, 16, 16)]


def test_paths(spark, controls):
    rows = [
        ("r", 1, "event", "a.cpp", 3, "Assuming 'p' is not equal to 0"), ("r", 2, "event", "a.cpp", 12, "walks"), ("s", 1, "event", "a.cpp", 3, "Assuming 'p' is equal to 7"), ("s", 2, "event", "a.cpp", 6, "in"),
        ("t", 1, "control", "a.cpp", 12, "Taking false branch"), ("t", 2, "event", "a.cpp", 12, "Assuming the condition is false"), ("u", 1, "event", "a.cpp", 7, "Assuming 'n' is not equal to 2"),
    ]
    events = spark.createDataFrame(rows, "report_key string, step int, kind string, file string, line int, message string")
    assert {tuple(r) for r in S.implicit_false(events, controls).collect()} == {("r", "a.cpp", 3, 1), ("u", "a.cpp", 7, 1)}
    assert S.short_circuits(events, controls).collect() == []  # neither assumption makes `p == 0` true
    decided = spark.createDataFrame([("r", "a.cpp", 3, True), ("r", "a.cpp", 12, False), ("r", "a.cpp", 7, None)], "report_key string, file string, line int, taken boolean")
    assert {tuple(r)[2:] for r in S.dead_ranges(decided, controls).collect()} == {(7, 9), (9, 11), (12, 12)}


RETURNS = """bool Box::ready(int n) {
  if (n > 3)
    return false;
  if (n == 2) {
    log("}");
    if (n) { return true; }
    return false;
  }
  if (n) return n;
  while (n) { return true; }
  return true;
}
static bool off() { return false; } // return true;
int none() { if (1) { go(); } return 3; }
"""


def test_truth_returns_belong_to_the_nearest_body(spark):
    files = spark.createDataFrame([("a.cpp", RETURNS), ("null", None), ("bad", "bool f() { if (x { return true; } ")], "file string, content string")
    found = {tuple(r) for r in S.truth_returns(files).collect()}
    assert found == {
        ("a.cpp", "Box::ready", "branch", 2, False), ("a.cpp", "Box::ready", "branch", 4, False), ("a.cpp", "Box::ready", "branch", 6, True),
        ("a.cpp", "Box::ready", "function", 12, True), ("a.cpp", "off", "function", 13, False),
    }
