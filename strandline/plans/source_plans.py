"""Readers of report and graph documents, on documents that are written from the supplied tables first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.plans.graph_plans import _NUMBERED_SQL, _numbered
from strandline.plans.registry import query
from strandline.session import table
from strandline.sources import cfg_text, csa_html, graphs, sarif


def _t(c):
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _join(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _documents(rows: DataFrame, key: str, order: str, text, between: str, head: str = "", tail: str = "") -> DataFrame:
    """path, content: the text of a key's rows in their order, joined."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))), lambda x: x["t"])
    per = rows.groupBy(key).agg(F.concat(F.lit(head), F.array_join(listed, between), F.lit(tail)).alias("content"))
    return per.select(_t(key).alias("path"), "content")


def _sarif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document of each customer, a result of each order, with a code flow of up to two places before its own."""
    k = F.col("o_orderkey")

    def place(line, message=None):
        at = F.struct(F.struct(_join("file:///src/f", k % 4, "%20x.c").alias("uri")).alias("artifactLocation"), F.struct(line.cast("int").alias("startLine"), F.lit(2).alias("startColumn")).alias("region")).alias("physicalLocation")
        return F.struct(at, F.struct(message.alias("text")).alias("message")) if message is not None else F.struct(at)

    steps = F.transform(F.filter(F.array(F.lit(1), F.lit(2)), lambda i: i <= k % 3), lambda i: F.struct(place(k % 20 + i, F.when(i == 2, "[Return] back").otherwise(_join("step ", i))).alias("location")))
    flows = F.array(F.struct(F.array(F.struct(steps.alias("locations"))).alias("threadFlows")))
    result = F.struct(
        _join("r", k % 3).alias("ruleId"), F.when(F.col("o_orderstatus") == "F", "warning").alias("level"), F.struct(_join("order ", k).alias("text")).alias("message"), F.array(place(k % 20 + 3)).alias("locations"), flows.alias("codeFlows"),
        F.when(F.col("o_orderstatus") == "O", F.array(F.struct(F.lit("external").alias("kind")))).alias("suppressions"),
    )
    rule = '{"version":"2.1.0","runs":[{"tool":{"driver":{"name":"CodeQL","rules":[{"id":"r0","properties":{"security-severity":"7.5"}},{"id":"r1","properties":{"problem.severity":"recommendation"}},{"id":"r2"}]}},"results":['
    rows = table(spark, sf_dir, "orders").withColumn("x", F.to_json(result))
    return _documents(rows, "o_custkey", "o_orderkey", F.col("x"), ",", rule, "]}]}").withColumn("doc", F.from_json("content", sarif.SCHEMA))


_SARIF_SQL = """f AS (SELECT o_custkey::VARCHAR AS path, o_orderkey AS k, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INTEGER AS result, 'r' || (o_orderkey % 3) AS rule_id, o_orderstatus AS s, '/src/f' || (o_orderkey % 4) || ' x.c' AS file, (o_orderkey % 20 + 3)::INTEGER AS line FROM orders),
    g AS (SELECT *, rule_id || ':' || file || ':' || line AS base FROM f), h AS (SELECT *, row_number() OVER (PARTITION BY path, base ORDER BY result) AS nth FROM g),
    i AS (SELECT *, CASE WHEN nth = 1 THEN base ELSE base || '#' || nth END AS finding_id FROM h)"""


@query(
    "sarif_findings",
    f"""WITH {_SARIF_SQL} SELECT path, result, finding_id, 'codeql' AS analyzer, rule_id, CASE rule_id WHEN 'r0' THEN 'error' WHEN 'r1' THEN 'note' ELSE CASE WHEN s = 'F' THEN 'warning' ELSE 'unknown' END END AS severity,
    'order ' || k AS message, file, line, 2 AS "column", s = 'O' AS suppressed, CASE WHEN k % 3 > 1 THEN 'trace' ELSE 'location' END AS path_evidence FROM i""",
)
def sarif_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sarif.findings(_sarif(spark, sf_dir))
    return found.select("path", "result", "finding_id", "analyzer", "rule_id", "severity", "message", "file", "line", "column", "suppressed", "path_evidence")


@query(
    "sarif_steps",
    f"""WITH {_SARIF_SQL}, p AS (SELECT *, (k % 3)::INTEGER AS n FROM i)
    SELECT finding_id, path, 1 AS step, 'event' AS kind, file, (k % 20 + 1)::INTEGER AS line, 'step 1' AS message FROM p WHERE n >= 1 UNION ALL SELECT finding_id, path, 2, 'return', file, (k % 20 + 2)::INTEGER, '[Return] back' FROM p WHERE n = 2
    UNION ALL SELECT finding_id, path, n + 1, 'report', file, line, 'order ' || k FROM p""",
)
def sarif_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sarif.steps(sarif.findings(_sarif(spark, sf_dir)))


def _html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of each order: its lines as listed source lines, each with a box that says something."""
    n = F.col("n")
    control = F.col("l_returnflag") == "R"
    said = F.when(control, F.when(F.col("l_linestatus") == "F", "Taking true branch").otherwise("Taking false branch")).when(F.col("l_returnflag") == "A", _join("Calling 'f", F.col("l_suppkey"), "'")).otherwise(_join("Assuming 'x' is &gt; ", F.col("l_suppkey")))
    row = _join(
        '<tr class="codeline" data-linenumber="', n * 3, '"><td class="num">', n * 3, '</td><td class="line">a[', F.col("l_partkey"), "] &lt; b;</td></tr>\n", '<div id="Path', n, '" class="msg ', F.when(control, "msgControl").otherwise("msgEvent"), '"><div>', n, "</div>", said, "</div>\n",
    )
    head = '<!-- BUGTYPE Null deref --><!-- BUGFILE src/a.cpp --><!-- BUGLINE 9 --><!-- FUNCTIONNAME go -->\n<h4 class="FileName">src/a.cpp</h4><table class="code">\n'
    reports = _documents(_numbered(spark, sf_dir), "l_orderkey", "n", row, "", head, "</table>")
    return reports.withColumn("m", csa_html.metadata(F.col("content"))).select("path", "content", "m.*")


@query(
    "html_events",
    f"""SELECT l_orderkey::VARCHAR AS path, n::INTEGER AS step, 'src/a.cpp' AS file, (n * 3)::INTEGER AS line, CASE l_returnflag WHEN 'R' THEN 'control' WHEN 'A' THEN 'call' ELSE 'assume' END AS kind, CASE WHEN l_returnflag = 'R' THEN l_linestatus = 'F' END AS direction,
    CASE WHEN l_returnflag = 'A' THEN 'f' || l_suppkey ELSE '' END AS callee, CASE WHEN l_returnflag NOT IN ('R', 'A') THEN 'Assuming ''x'' is > ' || l_suppkey ELSE '' END AS assumption FROM ({_NUMBERED_SQL})""",
)
def html_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csa_html.classify(csa_html.events(_html(spark, sf_dir))).select("path", "step", "file", "line", "kind", "direction", "callee", "assumption")


@query(
    "html_lines",
    f"""SELECT l_orderkey::VARCHAR AS path, 'src/a.cpp' AS file, (n * 3)::INTEGER AS line, 'a[' || l_partkey || '] < b;' AS text, 9 AS bug_line FROM ({_NUMBERED_SQL})""",
)
def html_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listings that reports carry, beside the line that their comments name."""
    reports = _html(spark, sf_dir)
    return csa_html.embedded_lines(reports).join(reports.select("path", "bug_line"), "path")


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dependence graph of each order: its lines as nodes, each used by the next one."""
    n = F.col("n")
    node = F.to_json(F.struct(
        _join("n", n).alias("id"), F.when(F.col("l_returnflag") == "R", "call_expr").alias("kind"), _join("this->f", F.col("l_suppkey") % 3, F.when(F.col("l_linestatus") == "F", " = 1").otherwise(" + 1")).alias("expression"), F.col("l_partkey").cast("int").alias("source_line"),
        (F.col("l_returnflag") == "R").alias("is_call"), F.when(F.col("l_returnflag") == "R", F.array(_t("l_suppkey"), F.lit("?"))).alias("actual_params"),
    ))
    return _documents(_numbered(spark, sf_dir), "l_orderkey", "n", node, ",", '{"metadata":{"version":"1.3"},"functions":[{"function_name":"go","source_file":"a.cpp","nodes":[', "]}]}")


@query(
    "graph_nodes",
    f"""SELECT l_orderkey::VARCHAR AS path, 'go' AS function_name, 'n' || n AS id, CASE WHEN l_returnflag = 'R' THEN 'call_expr' ELSE '' END AS kind, l_partkey::INTEGER AS source_line, l_returnflag = 'R' AS is_call,
    CASE WHEN l_returnflag = 'R' THEN l_suppkey || ',?' ELSE '' END AS params, (n - 1)::INTEGER AS ordinal FROM ({_NUMBERED_SQL})""",
)
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = graphs.read_pdg(_graph(spark, sf_dir))["nodes"]
    return nodes.select("path", "function_name", "id", "kind", "source_line", "is_call", F.array_join("actual_params", ",").alias("params"), "ordinal")


@query(
    "member_field_edges",
    f"""WITH s AS (SELECT l_orderkey::VARCHAR AS path, 'n' || n AS id, l_suppkey % 3 AS f, l_linestatus = 'F' AS d FROM ({_NUMBERED_SQL}))
    SELECT a.path, 'go' AS function_name, a.id AS def_node_id, b.id AS use_node_id, '[this].f' || a.f AS variable FROM s a JOIN s b ON a.path = b.path AND a.f = b.f AND a.d AND NOT b.d""",
)
def member_field_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.augment_member_fields(graphs.read_pdg(_graph(spark, sf_dir))["nodes"], F.col("expression").endswith(" = 1"))


@query(
    "call_graph_edges",
    f"""SELECT l_orderkey::VARCHAR AS path, 'f' || l_suppkey AS caller, 'f' || l_partkey AS callee, CASE WHEN l_returnflag = 'N' THEN NULL ELSE (n * 2)::INTEGER END AS line, l_linestatus = 'F' AS is_indirect, (n - 1)::INTEGER AS ordinal FROM ({_NUMBERED_SQL})""",
)
def call_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    call = F.to_json(F.struct(_join("f", F.col("l_suppkey")).alias("caller"), _join("f", F.col("l_partkey")).alias("callee"), F.when(F.col("l_returnflag") != "N", (F.col("n") * 2).cast("int")).alias("line"), F.when(F.col("l_linestatus") == "F", True).alias("is_indirect")))
    documents = _documents(_numbered(spark, sf_dir), "l_orderkey", "n", call, ",", '{"functions":[],"calls":[', "]}")
    return graphs.read_call_graph(documents)["calls"].select("path", "caller", "callee", "line", "is_indirect", "ordinal")


@query(
    "compile_commands",
    """SELECT o_custkey::VARCHAR AS path, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INTEGER AS ordinal, 'f' || o_orderkey || '.c' AS file, CASE WHEN o_orderstatus = 'F' THEN 'cc|-O2|-DX=' || o_orderpriority || '|-c' ELSE 'cc|f' || o_orderkey || '.c' END AS arguments FROM orders""",
)
def compile_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as entries, some with a command line, others with arguments."""
    file, told = _join("f", F.col("o_orderkey"), ".c"), F.col("o_orderstatus") == "F"
    entry = F.to_json(F.struct(F.lit("/d").alias("directory"), file.alias("file"), F.when(told, _join('cc  -O2 -DX="', F.col("o_orderpriority"), '" -c')).alias("command"), F.when(~told, F.array(F.lit("cc"), file)).alias("arguments")))
    documents = _documents(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", entry, ",", "[", "]")
    return graphs.read_compile_database(documents).select("path", "ordinal", "file", F.array_join("arguments", "|").alias("arguments"))


@query(
    "dumped_blocks",
    f"""WITH r AS (SELECT *, max(n) OVER (PARTITION BY l_orderkey) AS last FROM ({_NUMBERED_SQL}))
    SELECT l_orderkey::VARCHAR AS path, 'int f(int x)' AS function_name, 'B' || n AS block_id, CASE WHEN n = last THEN 'ENTRY' ELSE '' END AS label, l_partkey || '|[B' || n || '.1] > ' || l_suppkey AS statements, CASE WHEN l_returnflag = 'R' THEN 'if [B' || n || '.2]' END AS terminator,
    CASE WHEN n = last THEN '' ELSE 'B' || (n + 1) END AS predecessors, CASE WHEN l_returnflag = 'R' THEN 'B' || (n - 1) || '|B0' ELSE 'B' || (n - 1) END AS successors FROM r""",
)
def dumped_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each order as blocks of a dumped function, the last one its entry."""
    rows = _numbered(spark, sf_dir).withColumn("last", F.max("n").over(Window.partitionBy("l_orderkey")))
    n, branch = F.col("n"), F.col("l_returnflag") == "R"
    text = _join(
        " [B", n, F.when(n == F.col("last"), " (ENTRY)").otherwise(""), "]\n   1: ", F.col("l_partkey"), "\n   2: [B", n, ".1] > ", F.col("l_suppkey"), "\n", F.when(branch, _join("   T: if [B", n, ".2]\n")).otherwise(""),
        F.when(n == F.col("last"), "").otherwise(_join("   Preds (1): B", n + 1, "\n")), "   Succs (", F.when(branch, "2").otherwise("1"), "): B", n - 1, F.when(branch, " B0").otherwise(""), "\n",
    )
    found = cfg_text.blocks(_documents(rows, "l_orderkey", "n", text, "\n", "int f(int x)\n"))
    return found.select("path", "function_name", "block_id", "label", F.array_join("statements", "|").alias("statements"), "terminator", F.array_join(F.coalesce("predecessors", F.array()), "|").alias("predecessors"), F.array_join("successors", "|").alias("successors"))
