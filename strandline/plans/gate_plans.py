"""Verdict queries over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators import branches as B
from strandline.operators import gates as T
from strandline.plans.registry import query
from strandline.session import table


@query(
    "unsat_constraints",
    """SELECT o_custkey AS report_key, o_orderpriority AS subject, list_sort(list(DISTINCT o_orderstatus)) AS "values", list_sort(list(DISTINCT o_orderkey)) AS basis FROM orders GROUP BY ALL HAVING count(DISTINCT o_orderstatus) > 1""",
)
def unsat_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("report_key"), F.col("o_orderkey").alias("fact_id"), F.col("o_orderpriority").alias("subject"), F.lit("==").alias("operator"), F.col("o_orderstatus").alias("value")
    )
    return T.unsatisfiable(facts)


@query(
    "explored_verdicts",
    """WITH a AS (SELECT user_id || '-' || strftime(ts, '%Y-%m-%d') AS k, CASE event_type WHEN 'purchase' THEN 'TP' WHEN 'error' THEN 'FP' ELSE 'UNKNOWN' END AS v, value > 60 AS leak, value < 95 AS conforms FROM events),
    g AS (SELECT k, count(*)::BIGINT AS n, count(*) FILTER (v = 'TP' AND NOT leak) AS tp, count(*) FILTER (v = 'TP' AND leak AND conforms) AS f, count(*) FILTER (v = 'FP' AND leak AND conforms) AS g, bool_and(v = 'FP') AS fp FROM a GROUP BY k),
    o AS (SELECT *, f = 0 AND g >= least(2, n) AS agreed FROM g)
    SELECT k AS report_key, CASE WHEN tp > 0 THEN 'TP' WHEN agreed OR fp THEN 'FP' ELSE 'UNKNOWN' END AS verdict, CASE WHEN tp > 0 THEN 'reachable' WHEN agreed THEN 'leak consensus' WHEN fp THEN 'space exhausted' WHEN f > 0 AND g > 0 THEN 'leak contradiction' ELSE 'undecided' END AS reason, n AS n_attempts FROM o""",
)
def explored_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    report = F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    verdict = F.when(F.col("event_type") == "purchase", "TP").when(F.col("event_type") == "error", "FP").otherwise("UNKNOWN")
    attempts = events.select(report.alias("report_key"), verdict.alias("verdict"), (F.col("value") > 60).alias("leak"), (F.col("value") < 95).alias("conforms"), F.lit(True).alias("exhausted"))
    return T.explored_verdict(attempts)


@query(
    "fabricated_entry_states",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n, count(*) OVER (PARTITION BY l_orderkey) AS last FROM lineitem),
    s AS (SELECT l_orderkey AS k, n::INTEGER AS step, (10 * n)::INTEGER AS line, l_returnflag AS f, l_linestatus = 'F' AS d, l_partkey % 3 AS p, l_suppkey % 4 AS q, n, last FROM r),
    e AS (SELECT k, p AS v, line AS deref FROM s WHERE step = last),
    a AS (SELECT k FROM s WHERE n = 1 AND f <> 'N'),
    c AS (SELECT s.k, e.v, e.deref, min(s.step) AS step, s.line FROM s JOIN e ON s.k = e.k WHERE s.d AND s.q = 0 AND s.line < e.deref AND e.v < 2 GROUP BY ALL)
    SELECT c.k AS report_key, 'f' || c.k AS "function", 'p' || c.v AS parameter, c.line AS check_line, c.step AS check_step, c.deref AS deref_line FROM c SEMI JOIN a ON a.k = c.k
    WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.k = c.k AND s.step < c.step AND s.n > 1 AND s.f = 'A' AND s.p = c.v)""",
)
def fabricated_entry_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reports, their lines as steps: the first one may assume a null pointer, the last one dereferences one of the
    pointer parameters p0 and p1 (p2 is no pointer), others take the failing arm of a check or store to a parameter."""
    lines = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey")
    file, p = F.concat(F.col("l_orderkey").cast("string"), F.lit(".c")), (F.col("l_partkey") % 3).cast("string")
    lines = lines.withColumns({"_n": F.row_number().over(w.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")), "_last": F.count("*").over(w)})
    message = (
        F.when(F.col("_n") == F.col("_last"), F.concat(F.lit("Dereference of null pointer (loaded from variable 'p"), p, F.lit("')")))
        .when((F.col("_n") == 1) & (F.col("l_returnflag") != "N"), F.lit("Assuming pointer value is null"))
        .when((F.col("_n") > 1) & (F.col("l_returnflag") == "A"), F.concat(F.lit("The value 0 is stored to 'p"), p, F.lit("'"))).otherwise(F.lit("Taking a branch"))
    )
    at = (10 * F.col("_n")).cast("int")
    steps = lines.select(F.col("l_orderkey").alias("report_key"), F.col("_n").alias("step"), F.lit("event").alias("kind"), file.alias("file"), at.alias("line"), message.alias("message"), (F.col("l_linestatus") == "F").alias("direction"))
    orders = lines.select("l_orderkey").distinct()
    functions = orders.select(file.alias("file"), F.concat(F.lit("f"), F.col("l_orderkey").cast("string")).alias("name"), F.lit("char *p0, const T<int> * p1, int p2").alias("parameters"), F.lit(1).alias("low"), F.lit(1000).alias("high"))
    held = lines.where("l_suppkey % 4 = 0").select(file.alias("file"), at.alias("line"), F.lit("CHECK").alias("macro"), F.explode(F.array(F.lit("(p0 != nullptr)"), F.lit("!!p1"), F.lit("p2"), F.lit("!p0"), F.lit("p1 == NULL"))).alias("condition"))
    return T.fabricated_entry_state(orders.select(F.col("l_orderkey").alias("report_key"), F.lit("Dereference of null pointer").alias("bug_type")), steps, functions, held)


@query(
    "dead_ranges",
    """SELECT e.event_id, e.user_id, EXISTS (SELECT 1 FROM events r WHERE r.user_id = e.user_id AND r.event_type = 'error' AND e.event_id BETWEEN r.event_id AND r.event_id + 100) AS dead FROM events e""",
)
def dead_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    ranges = events.where("event_type = 'error'").select("user_id", F.col("event_id").alias("low"), (F.col("event_id") + 100).alias("high"))
    return T.falls_in_dead_range(events.select("event_id", "user_id"), ranges, "user_id", "event_id")


@query(
    "no_path_verdicts",
    """WITH n AS (SELECT o_orderkey AS report_key, count(l_orderkey)::BIGINT AS candidates, CASE WHEN o_orderstatus = 'F' THEN 'trace' ELSE 'location' END AS evidence FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 45 GROUP BY o_orderkey, o_orderstatus)
    SELECT *, CASE WHEN candidates = 0 AND evidence = 'trace' THEN 'FP' WHEN candidates = 0 THEN 'UNKNOWN' END AS verdict FROM n""",
)
def no_path_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").where("l_quantity > 45").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    reports = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left").select(
        F.col("o_orderkey").alias("report_key"), F.coalesce("n", F.lit(0)).alias("candidates"), F.when(F.col("o_orderstatus") == "F", "trace").otherwise("location").alias("evidence")
    )
    return T.no_path_verdict(reports, "candidates", "evidence")


@query(
    "call_return_violations",
    """WITH e AS (SELECT user_id AS path, event_id AS position, event_id % 3 AS kind, CASE WHEN event_id % 3 = 1 THEN 'f' || (event_id // 7 % 4) ELSE 'main' END AS fn, event_id // 10 % 3 AS line, 'f' || (event_id // 7 % 4) AS name, event_type, value > 20 AS taken FROM events),
    r AS (SELECT path, line, name, arg_min(CASE WHEN taken THEN (CASE WHEN event_type = 'click' THEN 0 ELSE 1 END) WHEN event_type = 'view' THEN -1 WHEN event_type = 'click' THEN 1 ELSE 0 END, position) AS required FROM e WHERE kind = 2 AND taken IS NOT NULL GROUP BY 1, 2, 3),
    b AS (SELECT 'f' || (n_nationkey % 4) AS fn, n_nationkey // 4 AS line, n_regionkey % 2 = 0 AS returned FROM nation), o AS (SELECT 'f' || r_regionkey AS fn, 100 + r_regionkey AS line, r_regionkey % 2 = 1 AS returned FROM region),
    g AS (SELECT path, e.fn, min(CASE WHEN taken THEN b.line END) AS early FROM e LEFT JOIN b ON e.fn = b.fn AND e.line = b.line WHERE kind = 1 GROUP BY 1, 2),
    s AS (SELECT path, g.fn, coalesce(b.returned, o.returned) AS selected, coalesce(b.line, o.line)::BIGINT AS return_line FROM g LEFT JOIN b ON g.fn = b.fn AND g.early = b.line LEFT JOIN o ON g.fn = o.fn)
    SELECT DISTINCT e.path, 'main' AS caller, e.line AS call_line, e.name AS callee, r.required = 1 AS required, selected, return_line, 'a' AS file
    FROM e JOIN r ON e.path = r.path AND e.line = r.line AND e.name = r.name JOIN s ON e.path = s.path AND e.name = s.fn WHERE kind = 0 AND required >= 0 AND (required = 1) <> selected""",
)
def call_return_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a path of calls, callee decisions and caller branches; nations and regions as what branches and functions return."""
    text = lambda c: c.cast("string")
    number, name = F.col("event_id"), F.concat(F.lit("f"), F.expr("CAST(event_id DIV 7 % 4 AS string)"))
    condition = F.when(F.col("event_type") == "click", F.concat(F.lit("!"), name, F.lit("(a)"))).when(F.col("event_type") == "view", F.concat(name, F.lit("() && b"))).otherwise(F.concat(name, F.lit("(c)")))
    kind = F.element_at(F.array(F.lit("call"), F.lit("control"), F.lit("branch")), (number % 3 + 1).cast("int"))
    decisions = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("path"), number.alias("position"), kind.alias("kind"), F.when(number % 3 == 1, F.concat(F.lit("ns::"), name)).otherwise("main").alias("function"), F.lit("a").alias("file"),
        F.expr("event_id DIV 10 % 3").alias("line"), F.when(number % 3 == 2, condition).alias("condition"), (F.col("value") > 20).alias("taken"), F.when(number % 3 == 0, name).alias("callee"),
    )
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    early = nation.select(F.lit("a").alias("file"), F.concat(F.lit("f"), text(F.col("n_nationkey") % 4)).alias("function"), F.lit("branch").alias("owner"), F.expr("n_nationkey DIV 4").alias("line"), (F.col("n_regionkey") % 2 == 0).alias("returned"))
    own = region.select(F.lit("a").alias("file"), F.concat(F.lit("f"), text(F.col("r_regionkey"))).alias("function"), F.lit("function").alias("owner"), (F.lit(100) + F.col("r_regionkey")).cast("long").alias("line"), (F.col("r_regionkey") % 2 == 1).alias("returned"))
    return B.call_return_violations(decisions, early.unionByName(own))


@query(
    "hard_constraint_conflicts",
    """WITH f AS (SELECT user_id AS report_key, event_type AS segment, event_id AS event, 'v' || (event_id % 5) AS variable, ['==', '<=', '>', '!='][event_id % 4 + 1] AS op, floor(value)::BIGINT AS v FROM events WHERE value IS NOT NULL),
    c AS (SELECT o_custkey AS report_key, 'v' || (o_orderkey % 5) AS variable, o_orderkey % 3 AS k, o_orderkey % 40 AS w, o_orderstatus AS s FROM orders),
    h AS (SELECT DISTINCT report_key, variable, CASE WHEN s = 'O' THEN '==' ELSE ['!=', '>=', '<'][k + 1] END AS hop, w FROM c WHERE s = 'F' OR s = 'O' AND k = 0),
    j AS (SELECT f.*, hop, w, CASE WHEN op IN ('==', '>=') THEN v WHEN op = '>' THEN v + 0.25 ELSE -1e15 END AS lo, CASE WHEN op IN ('==', '<=') THEN v WHEN op = '<' THEN v - 0.25 ELSE 1e15 END AS hi,
    CASE WHEN hop IN ('==', '>=') THEN w ELSE -1e15 END AS hlo, CASE WHEN hop = '==' THEN w WHEN hop = '<' THEN w - 0.25 ELSE 1e15 END AS hhi FROM f JOIN h USING (report_key, variable)),
    x AS (SELECT *, row_number() OVER (PARTITION BY report_key, segment ORDER BY event, hop, w::VARCHAR) AS n FROM j WHERE greatest(lo, hlo) > least(hi, hhi) OR v = w AND (op = '!=' AND hop = '==' OR op = '==' AND hop = '!='))
    SELECT report_key, segment, event, variable, op AS operator, v::VARCHAR AS value, hop AS hard_operator, w::VARCHAR AS hard_value FROM x WHERE n = 1""",
)
def hard_constraint_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a user's assumptions by segment (their type), checked against what the user's orders bind them to."""
    pick = lambda c, *ops: F.element_at(F.array(*map(F.lit, ops)), (c + 1).cast("int"))
    name = lambda c: F.concat(F.lit("v"), (F.col(c) % 5).cast("string")).alias("variable")
    facts = table(spark, sf_dir, "events").where("value IS NOT NULL").select(
        F.col("user_id").alias("report_key"), F.col("event_type").alias("segment"), F.col("event_id").alias("event"), name("event_id"),
        pick(F.col("event_id") % 4, "==", "<=", ">", "!=").alias("operator"), F.floor("value").cast("string").alias("value"),
    )
    result = F.when(F.col("o_orderstatus") == "F", "VIOLATED").when(F.col("o_orderstatus") == "O", "CONSISTENT").otherwise("UNCERTAIN")
    checked = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("report_key"), name("o_orderkey"), pick(F.col("o_orderkey") % 3, "==", "<", ">=").alias("operator"), (F.col("o_orderkey") % 40).cast("string").alias("value"), result.alias("result")
    )
    return T.first_conflicts(facts, T.hard_constraints(checked))
