"""Adapters on small documents made here."""

import json

from pyspark.sql import functions as F

from strandline.sources import cfg_text, csa_html, graphs, sarif, sinks
from strandline.streaming import incremental


def place(uri, line):
    return {"physicalLocation": {"artifactLocation": {"uri": uri, "uriBaseId": "%SRCROOT%"}, "region": {"startLine": line, "startColumn": 2}}}


def test_sarif_findings_and_steps(spark, tmp_path):
    flow = {"threadFlows": [{"locations": [{"location": place("a%20b.cpp", 3) | {"message": {"text": "source"}}}, {"location": place("x.cpp", 5) | {"message": {"text": "[Return] f"}}}]}]}
    short = {"threadFlows": [{"locations": [{"location": place("x.cpp", 9)}]}]}
    doc = {"version": "2.1.0", "runs": [{"tool": {"driver": {"name": "CodeQL", "rules": [{"id": "r1", "properties": {"security-severity": "7.5"}}, {"id": "r2"}]}}, "results": [
        {"ruleId": "r1", "message": {"text": "m"}, "locations": [place("x.cpp", 9)], "codeFlows": [short, flow], "partialFingerprints": {"p": "f1"}},
        {"ruleId": "r1", "message": {"text": "m"}, "locations": [place("x.cpp", 9)]},
        {"ruleIndex": 1, "level": "warning", "message": {"text": "n"}, "locations": [place("y.cpp", 1)], "suppressions": [{"kind": "external"}]}]}]}
    (tmp_path / "r.sarif").write_text(json.dumps(doc))
    found = sarif.findings(sarif.read_sarif(spark, str(tmp_path / "r.sarif"))).cache()
    rows = {r["finding_id"]: r for r in found.collect()}
    assert set(rows) == {"r1:x.cpp:9", "r1:x.cpp:9#2", "r2:y.cpp:1"}
    assert rows["r1:x.cpp:9"]["severity"] == "error" and rows["r2:y.cpp:1"]["severity"] == "warning"
    assert rows["r1:x.cpp:9"]["path_evidence"] == "trace" and rows["r1:x.cpp:9#2"]["path_evidence"] == "location"
    assert rows["r2:y.cpp:1"]["suppressed"] and rows["r1:x.cpp:9"]["analyzer"] == "codeql"
    steps = sarif.steps(found).where("finding_id = 'r1:x.cpp:9'").orderBy("step").collect()
    assert [(s["kind"], s["file"], s["line"]) for s in steps] == [("event", "a b.cpp", 3), ("return", "x.cpp", 5), ("report", "x.cpp", 9)]
    assert [r["finding_id"] for r in sarif.select_finding(found, "y.cpp:1").collect()] == ["r2:y.cpp:1"]
    assert sarif.select_finding(found, "r1").count() == 0


REPORT = """<!-- BUGTYPE Null deref --><!-- BUGFILE src/a.cpp --><!-- BUGLINE 7 --><!-- FUNCTIONNAME go --><!-- BUGPATHLENGTH 4 -->
<h4 class="FileName">src/a.cpp</h4><table class="code">
<tr class="codeline" data-linenumber="5"><td class="num">5</td><td class="line">int x<span class="macro_popup"><b>M</b></span> = 1;</td></tr>
<div id="Path1" class="msg msgEvent"><div class="n">1</div>Assuming the condition is false &rarr;</div>
<tr class="codeline" data-linenumber="6"><td class="num">6</td><td class="line">f(x);</td></tr>
<div id="Path3" class="msg msgControl"><div>3</div>Taking true branch</div>
<div id="Path2" class="msg msgEvent"><div>2</div>Calling 'f'</div>
</table><h4 class="FileName">src/b.h</h4><table class="code">
<tr class="codeline" data-linenumber="7"><td class="num">7</td><td class="line">*p = 1;</td></tr>
<div id="EndPath" class="msg msgEvent">Dereference of null pointer</div></table>"""


def test_html_report(spark, tmp_path):
    (tmp_path / "report-1.html").write_text(REPORT)
    reports = csa_html.read_reports(spark, str(tmp_path))
    head = reports.first()
    assert (head["bug_type"], head["bug_file"], head["bug_line"], head["function_name"], head["path_length"]) == ("Null deref", "src/a.cpp", 7, "go", 4)
    steps = csa_html.classify(csa_html.events(reports)).orderBy("step").collect()
    assert [(s["kind"], s["direction"], s["file"], s["line"], s["path_number"]) for s in steps] == [
        ("assume", False, "src/a.cpp", 5, 1), ("call", None, "src/a.cpp", 6, 2), ("control", True, "src/a.cpp", 6, 3), ("report", None, "src/b.h", 7, 9999)]
    assert steps[1]["callee"] == "f"
    lines = {(r["file"], r["line"]): r["text"] for r in csa_html.embedded_lines(reports).collect()}
    assert lines == {("src/a.cpp", 5): "int x = 1;", ("src/a.cpp", 6): "f(x);", ("src/b.h", 7): "*p = 1;"}


def test_cfg_text(spark):
    dump = "int f(int x)\n [B2 (ENTRY)]\n   Succs (1): B1\n\n [B1]\n   1: x\n   2: [B1.1] > 0\n   T: if [B1.2]\n   Preds (1): B2\n   Succs (2): B0 B0\n\n [B0 (EXIT)]\n   Preds (2): B1 B1\n\nvoid g()\n [B1 (ENTRY)]\n   Succs (1): B0\n [B0 (EXIT)]\n   Preds (1): B1\n"
    found = cfg_text.blocks(spark.createDataFrame([("d", dump)], "path string, content string"))
    rows = {(r["function_name"], r["block_id"]): r for r in found.collect()}
    assert len(rows) == 5
    b = rows["int f(int x)", "B1"]
    assert b["statements"] == ["x", "[B1.1] > 0"] and b["terminator"] == "if [B1.2]" and b["successors"] == ["B0", "B0"]
    assert rows["void g()", "B1"]["label"] == "ENTRY"
    assert {tuple(r)[1:] for r in cfg_text.edges(found).where("src = 'B1' AND function_name LIKE 'int%'").collect()} == {("int f(int x)", "B1", "B0", 0), ("int f(int x)", "B1", "B0", 1)}


def test_graph_artifacts(spark):
    doc = {"metadata": {"version": "1.3"}, "functions": [{"function_name": "f", "nodes": [{"id": "n1", "source_line": 3, "expression": "this->a = 1"}, {"id": "n2", "expression": "use(this->a)"}], "def_use_edges": [{"def_node_id": "n1", "use_node_id": "n2", "variable": "a"}]}]}
    docs = spark.createDataFrame([("p", json.dumps(doc)), ("q", "{}")], "path string, content string")
    assert {(r["path"], r["usable"]) for r in graphs.artifact_versions(docs).collect()} == {("p", True), ("q", False)}
    tables = graphs.read_pdg(docs)
    assert [(r["id"], r["source_line"], r["kind"], r["actual_params"]) for r in tables["nodes"].orderBy("ordinal").collect()] == [("n1", 3, "", []), ("n2", 0, "", [])]
    assert tables["def_use"].count() == 1 and tables["control_dep"].count() == 0
    extra = graphs.augment_member_fields(tables["nodes"], F.col("expression").rlike("this->\\w+ = "))
    assert [tuple(r)[2:] for r in extra.collect()] == [("n1", "n2", "[this].a")]


def test_line_markers_and_compile_database(spark):
    text = '# 1 "a.cpp"\nint x;\n# 40 "b.h" 2\nint y;\nint z;'
    lines = graphs.source_lines(spark.createDataFrame([("t", text)], "path string, content string"))
    assert [(r["text"], r["origin_file"], r["origin_line"]) for r in graphs.origin_lines(lines).orderBy("line").collect()] == [("int x;", "a.cpp", 1), ("int y;", "b.h", 40), ("int z;", "b.h", 41)]
    db = json.dumps([{"directory": "/d", "file": "a.c", "command": 'cc -DX="a b" -c a.c'}, {"directory": "/d", "file": "b.c", "arguments": ["cc", "b.c"]}])
    found = graphs.read_compile_database(spark.createDataFrame([("c", db)], "path string, content string")).orderBy("ordinal").collect()
    assert [r["arguments"] for r in found] == [["cc", "-DX=a b", "-c", "a.c"], ["cc", "b.c"]]


def test_incremental_equals_batch(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "report-1.html").write_text(REPORT)
    stream = incremental.watch_documents(spark, str(inbox), "*.html")
    incremental.run_incrementally(stream, lambda b: b.select("path", csa_html.metadata(F.col("content"))["bug_line"].alias("bug_line")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert [r["bug_line"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [7]
    sinks.write_manifest(str(tmp_path / "m.json"), {"reports": 1})
    assert json.loads((tmp_path / "m.json").read_text()) == {"reports": 1}


def test_cfg_text_takes_the_last_function_of_a_name_and_shuffles_nothing(spark):
    once = "int f(int x)\n [B1 (ENTRY)]\n   1: a\n   Succs (1): B0\n"
    dump = once + "\nvoid g()\n\n [B2]\n   1: b\n [B3]\n   1: c\n   T: while [B3.1]\n [B2]\n   2: d\n   Preds (1): B3\n" + once.replace("1: a", "1: z")
    found = cfg_text.blocks(spark.createDataFrame([("d", dump), ("n", None), ("e", "f()\n[B")], "path string, content string"))
    assert sorted((r["function_name"], r["block_id"], r["label"], r["statements"], r["terminator"], r["predecessors"], r["successors"]) for r in found.collect()) == [
        ("int f(int x)", "B1", "ENTRY", ["z"], None, [], ["B0"]), ("void g()", "B2", "", ["b", "d"], None, ["B3"], []), ("void g()", "B3", "", ["c"], "while [B3.1]", [], [])]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_cfg_text_reads_a_dump_once(spark):
    dump = "f()\n" + "".join(f" [B{i}]\n   1: x{i}\n   Succs (1): B{i - 1}\n" for i in range(12_000, 0, -1)) + " [B12000]\n   2 : y\r\n  T: if [B1.1]\n   Preds (2): B7\tB8 \n"
    found = cfg_text.blocks(spark.createDataFrame([(7, dump)], "path long, content string"))
    rows = {r["block_id"]: r for r in found.collect()}
    assert len(rows) == 12_000 and {r["path"] for r in rows.values()} == {7} and rows["B5"]["successors"] == ["B4"]
    last = rows["B12000"]
    assert last["statements"] == ["x12000", "y"] and last["terminator"] == "if [B1.1]" and last["predecessors"] == ["B7", "B8"] and last["successors"] == ["B11999"]
    assert "lambda" not in found._jdf.queryExecution().executedPlan().toString()
