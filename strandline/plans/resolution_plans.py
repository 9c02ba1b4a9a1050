"""Ladder and slice queries over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators import resolution as R
from strandline.operators import slices as S
from strandline.operators.graph import settle
from strandline.plans.graph_plans import _NUMBERED_SQL, _numbered
from strandline.plans.registry import query
from strandline.session import table


def _t(c):
    return (F.col(c) if isinstance(c, str) else c).cast("string")


_PATH_SQL = "'Brand#' || (o_custkey % 5 + 1) || (o_orderkey % 5 + 1) || '/d' || (o_custkey % 5) || '/f' || (o_orderkey % 6) || '.c'"


@query(
    "file_ladder",
    f"""WITH t AS (SELECT DISTINCT '/src/' || p_brand || '/d' || (p_size % 5) || '/f' || (p_partkey % 4) || '.c' AS local FROM part WHERE right(p_brand, 1) IN ('1', '2', '3')),
    r AS (SELECT DISTINCT CASE o_orderkey % 7 WHEN 0 THEN '/src/' || p WHEN 1 THEN '/build/x/' || p WHEN 2 THEN p WHEN 3 THEN '/usr/' || p WHEN 4 THEN '/build/' || p WHEN 5 THEN '/q/' || regexp_extract(p, '[^/]*$') ELSE './' || p END AS reported FROM (SELECT *, {_PATH_SQL} AS p FROM orders)),
    p AS (SELECT reported, starts_with(reported, '/') AS absolute, list_filter(string_split(reported, '/'), lambda x: x NOT IN ('', '.')) AS parts FROM r),
    b AS (SELECT reported, 1 AS rank, o, list_filter(string_split(substr(reported, length(pre) + 1), '/'), lambda x: x NOT IN ('', '.')) AS parts FROM p JOIN (VALUES ('/build/x', 0), ('/build', 1)) AS v(pre, o) ON starts_with(reported, pre)
        UNION ALL SELECT reported, 2, 0, parts FROM p WHERE NOT absolute UNION ALL SELECT reported, 3, 0, parts FROM p),
    c AS (SELECT reported, 0 AS rank, 0 AS o, 0 AS cut, reported AS local FROM p WHERE absolute UNION ALL SELECT reported, rank, o, cut, '/src/' || array_to_string(list_slice(parts, cut + 1, len(parts)), '/') FROM (SELECT *, unnest(range(len(parts))) AS cut FROM b)),
    m AS (SELECT reported, min(rank) AS rank, arg_min(local, (rank, o, cut)) AS local FROM c SEMI JOIN t USING (local) GROUP BY reported),
    n AS (SELECT regexp_extract(local, '[^/]*$') AS base, min(local) AS local, count(*) AS rivals FROM t GROUP BY 1)
    SELECT p.reported, CASE WHEN m.rank IS NOT NULL THEN ['direct', 'build-prefix', 'relative', 'suffix'][m.rank + 1] WHEN n.local IS NOT NULL THEN 'basename' ELSE 'unresolved' END AS strategy,
    coalesce(m.local, n.local) AS local, CASE WHEN m.rank IS NULL AND n.local IS NOT NULL THEN n.rivals ELSE 0 END AS rivals FROM p LEFT JOIN m USING (reported) LEFT JOIN n ON n.base = parts[len(parts)]""",
)
def file_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths as orders report them against the files that parts make up."""
    parts = table(spark, sf_dir, "part").where(F.substring("p_brand", -1, 1).isin("1", "2", "3"))
    tree = parts.select(F.concat(F.lit("/src/"), "p_brand", F.lit("/d"), _t(F.col("p_size") % 5), F.lit("/f"), _t(F.col("p_partkey") % 4), F.lit(".c")).alias("local"))
    customer, order = F.col("o_custkey"), F.col("o_orderkey")
    path = F.concat(F.lit("Brand#"), _t(customer % 5 + 1), _t(order % 5 + 1), F.lit("/d"), _t(customer % 5), F.lit("/f"), _t(order % 6), F.lit(".c"))
    forms = ["/src/", "/build/x/", "", "/usr/", "/build/"]
    told = F.when(order % 7 == 5, F.concat(F.lit("/q/"), F.element_at(F.split(path, "/"), -1))).when(order % 7 == 6, F.concat(F.lit("./"), path))
    for i, form in enumerate(forms):
        told = told.when(order % 7 == i, F.concat(F.lit(form), path))
    return R.resolve_files(table(spark, sf_dir, "orders").select(told.alias("reported")), tree, "/src", ["/build", "/build/x"])


@query(
    "function_ladder",
    """WITH k AS (SELECT 'ns' || p_size || '::C' || (p_partkey % 20) || '::m' || (p_partkey % 400) AS target, p_partkey AS o FROM part),
    a AS (SELECT o_orderkey AS ask, 's' || (o_custkey % 100 + 1) AS caller, CASE o_orderkey % 4 WHEN 0 THEN 'ns' || (o_custkey % 50 + 1) || '::C' || (o_orderkey % 20) || '::m' || (o_orderkey % 400) WHEN 1 THEN 'C' || (o_custkey % 20) || '::m' || (o_custkey % 400)
        WHEN 2 THEN 'm' || (o_orderkey % 1200) ELSE 'int *X<a<b>>::m' || (o_custkey % 500) || '<c, d<e>>(const f<g> &)' END AS name FROM orders),
    s AS (SELECT *, CASE WHEN name LIKE 'int *%' THEN regexp_extract(name, '::(m[0-9]*)<', 1) ELSE regexp_extract(name, '[^:]*$') END AS short FROM a),
    e AS (SELECT target AS name, arg_min(target, o) AS t FROM k GROUP BY 1), f AS (SELECT name, arg_min(target, (o, target)) AS t FROM (SELECT *, unnest([split_part(target, '::', 2) || '::' || split_part(target, '::', 3), split_part(target, '::', 3)]) AS name FROM k) GROUP BY 1),
    m AS (SELECT split_part(target, '::', 3) AS short, arg_min(target, (o, target)) AS t FROM k GROUP BY 1),
    c AS (SELECT 's' || l_suppkey AS caller, 'q::m' || (l_partkey % 3000) AS callee, min(l_orderkey) AS o FROM lineitem GROUP BY 1, 2),
    g AS (SELECT s.caller, s.name, arg_min(callee, (o, callee)) FILTER (callee = s.name OR ends_with(callee, '::' || s.name)) AS t3, arg_min(callee, (o, callee)) FILTER (NOT (callee = s.name OR ends_with(callee, '::' || s.name))) AS t4
        FROM (SELECT DISTINCT caller, name FROM s WHERE name NOT IN (SELECT name FROM e) AND name NOT IN (SELECT name FROM f) AND short NOT IN (SELECT short FROM m)) AS s JOIN c ON c.caller = s.caller AND contains(callee, s.name) GROUP BY 1, 2)
    SELECT ask, CASE WHEN e.t IS NOT NULL THEN 'exact' WHEN f.t IS NOT NULL THEN 'suffix' WHEN m.t IS NOT NULL THEN 'method' WHEN t3 IS NOT NULL THEN 'callee' WHEN t4 IS NOT NULL THEN 'mention' ELSE 'unresolved' END AS strategy, coalesce(e.t, f.t, m.t, t3, t4) AS target
    FROM s LEFT JOIN e USING (name) LEFT JOIN f USING (name) LEFT JOIN m USING (short) LEFT JOIN g ON g.caller = s.caller AND g.name = s.name""",
)
def function_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that orders ask for, resolved against parts as methods and the calls of suppliers."""
    known = table(spark, sf_dir, "part").select(F.concat(F.lit("ns"), _t("p_size"), F.lit("::C"), _t(F.col("p_partkey") % 20), F.lit("::m"), _t(F.col("p_partkey") % 400)).alias("name"), F.col("p_partkey").alias("ordinal"))
    customer, order = F.col("o_custkey"), F.col("o_orderkey")
    name = (
        F.when(order % 4 == 0, F.concat(F.lit("ns"), _t(customer % 50 + 1), F.lit("::C"), _t(order % 20), F.lit("::m"), _t(order % 400))).when(order % 4 == 1, F.concat(F.lit("C"), _t(customer % 20), F.lit("::m"), _t(customer % 400)))
        .when(order % 4 == 2, F.concat(F.lit("m"), _t(order % 1200))).otherwise(F.concat(F.lit("int *X<a<b>>::m"), _t(customer % 500), F.lit("<c, d<e>>(const f<g> &)")))
    )
    asked = table(spark, sf_dir, "orders").select(order.alias("ask"), name.alias("name"), F.concat(F.lit("s"), _t(customer % 100 + 1)).alias("caller"))
    calls = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), _t("l_suppkey")).alias("caller"), F.concat(F.lit("q::m"), _t(F.col("l_partkey") % 3000)).alias("callee"), F.col("l_orderkey").alias("ordinal"))
    return R.resolve_functions(asked, known, calls)


@query(
    "nearest_definitions",
    """WITH d AS (SELECT 'm' || (p_partkey % 97) AS name, 'src/' || p_brand || '/' || (p_size % 4) || '.c' AS file, 'src/' || p_brand AS folder, p_partkey AS o FROM part),
    a AS (SELECT o_orderkey AS ask, 'm' || (o_orderkey % 100) AS name, CASE o_custkey % 3 WHEN 0 THEN 'src/Brand#1' || (o_orderkey % 5 + 1) || '/' || (o_custkey % 4) || '.c' WHEN 1 THEN 'src/Brand#2' || (o_orderkey % 5 + 1) END AS hint FROM orders),
    j AS (SELECT ask, file, o, CASE WHEN file = hint THEN 0 WHEN folder = hint THEN 1 WHEN folder = regexp_replace(hint, '/?[^/]*$', '') THEN 2 ELSE 3 END AS tier FROM a JOIN d USING (name))
    SELECT ask, ['file', 'folder', 'folder', 'first'][min(tier) + 1] AS tier, arg_min(file, (tier, o)) AS file, (arg_min(o, (tier, o)) % 1000)::INTEGER AS first_line, (arg_min(o, (tier, o)) % 1000 + 9)::INTEGER AS last_line FROM j GROUP BY ask""",
)
def nearest_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods that orders call from a file, from a folder or from nowhere, defined by parts."""
    first = (F.col("p_partkey") % 1000).cast("int")
    definitions = table(spark, sf_dir, "part").select(
        F.concat(F.lit("m"), _t(F.col("p_partkey") % 97)).alias("name"), F.concat(F.lit("src/"), "p_brand", F.lit("/"), _t(F.col("p_size") % 4), F.lit(".c")).alias("file"), F.col("p_partkey").alias("ordinal"), first.alias("first_line"), (first + 9).alias("last_line")
    )
    customer, order = F.col("o_custkey"), F.col("o_orderkey")
    hint = F.when(customer % 3 == 0, F.concat(F.lit("src/Brand#1"), _t(order % 5 + 1), F.lit("/"), _t(customer % 4), F.lit(".c"))).when(customer % 3 == 1, F.concat(F.lit("src/Brand#2"), _t(order % 5 + 1)))
    return R.pick_definitions(table(spark, sf_dir, "orders").select(order.alias("ask"), F.concat(F.lit("m"), _t(order % 100)).alias("name"), hint.alias("hint")), definitions)


@query(
    "event_files",
    """WITH e AS (SELECT user_id AS report, event_id AS event, floor(coalesce(value, 0))::BIGINT AS line, CASE WHEN event_type = 'click' THEN 'C' || (event_id % 40) END AS class, CASE WHEN event_type = 'view' THEN 'src/C' || (event_id % 60) || '.cc' END AS file FROM events),
    r AS (SELECT c_custkey AS report, 'src/C' || (c_custkey % 9) || '.cc' AS bug FROM customer),
    t AS (SELECT DISTINCT 'src/C' || p_size || '.' || CASE WHEN p_partkey % 2 = 0 THEN 'cc' ELSE 'cpp' END AS local FROM part WHERE p_size < 30),
    c AS (SELECT DISTINCT e.report, class, CASE WHEN 'src/' || class || '.cc' IN (SELECT local FROM t) THEN 'src/' || class || '.cc' WHEN 'src/' || class || '.cpp' IN (SELECT local FROM t) THEN 'src/' || class || '.cpp' END AS file FROM e WHERE class IS NOT NULL),
    l AS (SELECT 'src/C' || (p_partkey % 80) || '.cc' AS file, p_size::BIGINT AS line, p_partkey AS o FROM part),
    y AS (SELECT line, arg_min(file, o) AS f FROM l GROUP BY line),
    d AS (SELECT e.report, event, coalesce(e.file, c.file) AS file, CASE WHEN e.file IS NOT NULL THEN 'own' ELSE 'class' END AS how FROM e LEFT JOIN c ON c.report = e.report AND c.class = e.class WHERE coalesce(e.file, c.file) IS NOT NULL),
    w AS (SELECT e.* FROM e ANTI JOIN d USING (report, event) WHERE line > 0),
    i1 AS (SELECT report, line, arg_min(l.file, o) AS f FROM (SELECT DISTINCT report, file FROM d) AS k JOIN l USING (file) GROUP BY 1, 2),
    p1 AS (SELECT w.report, event, coalesce(i1.f, y.f) AS file FROM w LEFT JOIN i1 USING (report, line) LEFT JOIN y ON y.line = w.line WHERE coalesce(i1.f, y.f) IS NOT NULL),
    k2 AS (SELECT report, file FROM d UNION SELECT report, file FROM p1),
    i2 AS (SELECT report, line, arg_min(l.file, o) AS f FROM k2 JOIN l USING (file) GROUP BY 1, 2),
    s2 AS (SELECT DISTINCT report, line, l.file FROM k2 JOIN l USING (file)),
    p2 AS (SELECT w.report, w.event, coalesce(s2.file, i2.f, y.f) AS file FROM w LEFT JOIN s2 ON s2.report = w.report AND s2.line = w.line AND s2.file = 'src/' || w.class || '.cc' LEFT JOIN i2 ON i2.report = w.report AND i2.line = w.line LEFT JOIN y ON y.line = w.line WHERE coalesce(s2.file, i2.f, y.f) IS NOT NULL)
    SELECT report, event, file, how FROM d UNION ALL SELECT report, event, file, 'line' FROM p2
    UNION ALL SELECT e.report, e.event, bug, 'bug' FROM e LEFT JOIN r USING (report) WHERE e.event NOT IN (SELECT event FROM d) AND e.event NOT IN (SELECT event FROM p2)""",
)
def event_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a report: views name their file, clicks call a class, others have a line alone."""
    events, part = table(spark, sf_dir, "events"), table(spark, sf_dir, "part")
    said = F.when(F.col("event_type") == "click", F.concat(F.lit("Calling 'C"), _t(F.col("event_id") % 40), F.lit("::go'")))
    own = F.when(F.col("event_type") == "view", F.concat(F.lit("src/C"), _t(F.col("event_id") % 60), F.lit(".cc")))
    asked = events.select(F.col("user_id").alias("report"), F.col("event_id").alias("event"), F.floor(F.coalesce("value", F.lit(0.0))).cast("long").alias("line"), said.alias("description"), own.alias("file"))
    reports = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("report"), F.concat(F.lit("src/C"), _t(F.col("c_custkey") % 9), F.lit(".cc")).alias("bug_file"))
    tree = part.where("p_size < 30").select(F.concat(F.lit("src/C"), _t("p_size"), F.when(F.col("p_partkey") % 2 == 0, ".cc").otherwise(".cpp")).alias("local"))
    lines = part.select(F.concat(F.lit("src/C"), _t(F.col("p_partkey") % 80), F.lit(".cc")).alias("file"), F.col("p_size").cast("long").alias("line"), F.col("p_partkey").alias("ordinal"))
    return R.event_files(asked, reports, lines, R.class_files(asked, reports, tree, "src"))


@query(
    "context_slice",
    f"""WITH RECURSIVE o AS (SELECT l_orderkey AS f, n, l_returnflag AS g, l_linestatus = 'F' AS c, l_tax > 0.04 AS two, l_partkey AS k, max(n) OVER (PARTITION BY l_orderkey) AS last FROM ({_NUMBERED_SQL})),
    h AS (SELECT f, n, k AS callee FROM o WHERE g = 'R' AND k < f AND k IN (SELECT f FROM o)),
    d AS (SELECT f, CASE WHEN n = 1 THEN 0 ELSE n - 1 END AS src, n AS dst, 0 AS pos FROM o WHERE g <> 'N' UNION ALL SELECT f, -1, n, 1 FROM o WHERE two),
    i AS (SELECT d.f, d.dst AS n, src AS "on" FROM d ANTI JOIN h ON h.f = d.f AND h.n = d.dst UNION SELECT f, n, 1 FROM o WHERE c AND n > 1),
    a AS (SELECT h.f, h.n, h.callee, 0 AS pos, CASE WHEN h.n = 1 THEN 0 ELSE h.n - 1 END AS node FROM h UNION ALL SELECT f, n, callee, 1, -1 FROM h),
    w(f, n, stack) AS (SELECT l.f, l.n, []::VARCHAR[] FROM o AS l JOIN orders ON o_orderkey = l.f WHERE l.n = l.last AND o_orderpriority = '1-URGENT'
        UNION SELECT * FROM (
            SELECT w.f, i."on", stack FROM w JOIN i ON i.f = w.f AND i.n = w.n
            UNION ALL SELECT h.callee, r.n, list_append(stack, w.f || ':' || w.n) FROM w JOIN h ON h.f = w.f AND h.n = w.n JOIN o AS r ON r.f = h.callee AND r.n = r.last
            UNION ALL SELECT a.f, unnest(CASE WHEN c AND a.n > 1 THEN [a.node, 1] ELSE [a.node] END), stack[1:len(stack) - 1] FROM w JOIN a ON a.callee = w.f AND a.pos = -w.n JOIN o AS s ON s.f = a.f AND s.n = a.n
                WHERE w.n <= 0 AND (len(stack) = 0 OR stack[len(stack)] = a.f || ':' || a.n)))
    SELECT DISTINCT f AS "function", n AS node FROM w""",
)
def context_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as functions of two parameters (nodes 0 and -1) whose returned lines call the order of their part's number, if
    that is an earlier one; sliced from the last lines of urgent orders."""
    rows = _numbered(spark, sf_dir).withColumn("last", F.max("n").over(Window.partitionBy("l_orderkey")))
    rows = settle(rows.select("l_orderkey", "n", "last", "l_returnflag", "l_linestatus", "l_tax", "l_partkey"))  # several steps read them: the lines are numbered once
    n, f = F.col("n"), F.col("l_orderkey").alias("function")
    functions = rows.select(F.col("l_orderkey").alias("l_partkey")).distinct()
    before, name = F.when(n == 1, F.lit(0).cast("long")).otherwise(n - 1), lambda c: F.concat(F.lit("w"), _t(c))
    second = F.lit(-1).cast("long")
    data = rows.where("l_returnflag <> 'N'").select(f, before.alias("src"), n.alias("dst"), name(before).alias("variable")).unionByName(rows.where("l_tax > 0.04").select(f, second.alias("src"), n.alias("dst"), name(second).alias("variable")))
    control = rows.where("l_linestatus = 'F' AND n > 1").select(f, F.lit(1).cast("long").alias("src"), n.alias("dst"))
    made = rows.where("l_returnflag = 'R' AND l_partkey < l_orderkey").join(functions, "l_partkey", "left_semi")
    arguments = F.explode(F.array(F.struct(F.lit(0).alias("position"), name(before).alias("variable")), F.struct(F.lit(1).alias("position"), name(second).alias("variable"))))
    calls = made.select(f, n.alias("call"), F.col("l_partkey").alias("callee"), arguments.alias("a")).select("function", "call", "callee", "a.*")
    own = rows.select(f).distinct()
    formals = own.select("function", F.explode(F.array(F.lit(0), F.lit(1))).alias("position")).withColumn("node", -F.col("position").cast("long"))
    returns = rows.where("n = last").select(f, n.alias("node"))
    defines = rows.select(f, n.alias("node"), name(n).alias("variable")).unionByName(formals.select("function", "node", name("node").alias("variable")))
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("function"))
    return S.context_slice(returns.join(urgent, "function", "left_semi"), data, control, calls, formals, returns, defines)
