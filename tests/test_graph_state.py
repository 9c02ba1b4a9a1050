"""File states over a stream that is stopped and started again, and graphs of reports."""

import json

from strandline.streaming import graph_state as G


def drop(folder, name, rows):
    (folder / name).write_text("\n".join(json.dumps(dict(zip(("file", "attempt", "outcome", "message"), r))) for r in rows))


def run(spark, source, out, checkpoint):
    attempts = spark.readStream.schema("file string, attempt long, outcome string, message string").json(str(source))

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    G.file_status(attempts).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start().awaitTermination()
    return {r["file"]: (r["status"], r["attempt"], r["failures"], r["message"]) for r in G.latest_status(spark.read.parquet(str(out))).collect()}


def test_states_outlive_a_restart(spark, tmp_path):
    source, out, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "checkpoint"
    source.mkdir()
    drop(source, "1.json", [("a", 1, "parsed", None), ("b", 1, "timeout", None), ("c", 1, "crashed", "signal 11"), ("c", 2, "crashed", "again"), ("d", 2, "parsed", None), ("d", 1, "timeout", None), (None, 1, "parsed", None), ("e", None, "parsed", None)])
    first = run(spark, source, out, checkpoint)
    assert first == {"a": ("parsed", 1, 0, None), "b": ("retry", 1, 1, "timeout"), "c": ("failed", 2, 2, "again"), "d": ("parsed", 2, 0, None)}
    drop(source, "2.json", [("b", 2, "timeout", "slow"), ("c", 2, "crashed", "seen before"), ("a", 1, "crashed", "seen before"), ("f", 1, "partial", "half")])
    second = run(spark, source, out, checkpoint)
    assert second == first | {"b": ("failed", 2, 2, "slow"), "f": ("partial", 1, 0, "half")}
    drop(source, "3.json", [("c", 3, "parsed", None), ("a", 2, "timeout", "later")])
    assert run(spark, source, out, checkpoint) == second | {"c": ("parsed", 3, 0, None), "a": ("retry", 2, 1, "later")}


def test_a_report_has_the_graph_of_its_usable_files(spark):
    frame = spark.createDataFrame
    references = frame([("r", 0, "x.c"), ("r", 1, None), ("r", 2, "y.c"), ("r", 3, "x.c"), ("r", 4, "z.c"), ("r", 5, "w.c"), ("q", 0, None)], "report string, ordinal int, file string")
    statuses = frame([("x.c", "parsed"), ("y.c", "partial"), ("z.c", "failed")], "file string, status string")
    functions = frame([("x.c", "go", 5, 9), ("y.c", "go", 3, 4), ("y.c", "N::own", 7, 8), ("z.c", "lost", 1, 2), ("w.c", "far", 1, 2)], "file string, name string, first_line int, last_line int")
    files = G.report_files(references, 3)
    assert {tuple(r) for r in files.collect()} == {("r", "x.c", 1), ("r", "y.c", 2), ("r", "z.c", 3)}
    graph = G.report_graph(files, statuses, functions).cache()
    assert {(r["id"], r["file"]) for r in graph.collect()} == {("go", "x.c"), ("go#L3", "y.c"), ("N::own", "y.c")}
    calls = frame([("x.c", 6, "own"), ("x.c", 7, "M::go"), ("y.c", 8, "lost"), ("z.c", 2, "own")], "file string, line int, callee string")
    assert {tuple(r)[2:] for r in G.report_calls(files, graph, calls).collect()} == {(6, "own", "N::own", "syntactic"), (7, "M::go", None, "candidate"), (8, "lost", None, "unresolved")}
    assert {tuple(r) for r in G.graph_summary(references, files, statuses, graph).collect()} == {("r", 3, 2, 1, 1, 3), ("q", 0, 0, 0, 1, 0)}
    reports = frame([("r", "own", "", 0), ("q", "own", "x.c", 5)], "report string, function string, file string, line int")
    lines = frame([("x.c", 5), ("y.c", 7)], "file string, line int")
    said = lambda rows: {r["report"]: r["covered"] for r in G.covered_reports(rows, graph, lines).collect()}
    assert said(reports) == {"r": True, "q": False}
    assert said(frame([("r", "nope", "/b/x.c", 5)], reports.schema)) == {"r": True} and said(frame([("r", "", "/b/x.c", 6)], reports.schema)) == {"r": False}
    assert said(frame([("r", None, "x.c", None)], reports.schema)) == {"r": True} and said(frame([("r", "wn", None, 5)], reports.schema)) == {"r": False}
