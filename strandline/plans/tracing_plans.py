"""Constant, callee, selection and short-circuit queries over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators import callees, constants, selection, structure
from strandline.plans.graph_plans import _NUMBERED_SQL, _numbered
from strandline.plans.registry import query
from strandline.session import table
from strandline.streaming import graph_state


def _t(c):
    return (F.col(c) if isinstance(c, str) else c).cast("string")


@query(
    "parameter_constants",
    """WITH RECURSIVE a AS (SELECT 'parameter:K' || o_custkey || ':0' AS slot, CASE WHEN o_totalprice < 20000 THEN NULL WHEN o_orderstatus = 'O' THEN 'getter:n' || (o_custkey % 25) WHEN o_orderstatus = 'P' THEN 'option:PREF_N' || (o_custkey % 6) END AS src,
        CASE WHEN o_totalprice < 20000 OR o_orderstatus IN ('O', 'P') THEN NULL WHEN o_orderkey % 9 = 0 THEN (o_orderkey % 3)::VARCHAR ELSE (o_custkey % 4)::VARCHAR END AS v FROM orders),
    e AS (SELECT src, slot AS dst FROM a WHERE src IS NOT NULL UNION SELECT 'parameter:K' || c_custkey || ':0', 'field:f' || c_nationkey FROM customer WHERE c_custkey % 7 = 0 UNION SELECT 'field:f' || n_nationkey, 'getter:n' || n_nationkey FROM nation),
    s AS (SELECT slot, coalesce(v, '?') AS v FROM a WHERE src IS NULL UNION SELECT 'option:PREF_N' || n_nationkey, n_regionkey::VARCHAR FROM nation WHERE n_nationkey < 5),
    b AS (SELECT DISTINCT src FROM e WHERE src NOT IN (SELECT slot FROM s) AND src NOT IN (SELECT dst FROM e)),
    w(slot, v) AS (SELECT slot, v FROM s UNION SELECT src, '?' FROM b UNION SELECT e.dst, w.v FROM w JOIN e ON e.src = w.slot),
    g AS (SELECT slot, bool_or(v = '?') AS unknown, count(DISTINCT v) AS n, min(v) AS v FROM w GROUP BY slot)
    SELECT 'K' || o_custkey AS callee, 0 AS position, CASE WHEN g.slot IS NULL OR unknown THEN 'unknown' WHEN n > 1 THEN 'conflict' ELSE 'constant' END AS state, CASE WHEN NOT unknown AND n = 1 THEN g.v END AS value, count(*) AS sites
    FROM orders LEFT JOIN g ON g.slot = 'parameter:K' || o_custkey || ':0' GROUP BY ALL""",
)
def parameter_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as calls of their customer's constructor; some customers set a field of their nation, which has a getter."""
    order, customer = F.col("o_orderkey"), F.col("o_custkey")
    text = (
        F.when(F.col("o_totalprice") < 20000, "x + 1").when(F.col("o_orderstatus") == "O", F.concat(F.lit("c->n"), _t(customer % 25), F.lit("()"))).when(F.col("o_orderstatus") == "P", F.concat(F.lit("o->get(PREF_N"), _t(customer % 6), F.lit(")")))
        .when(order % 9 == 0, _t(order % 3)).otherwise(_t(customer % 4))
    )
    arguments = table(spark, sf_dir, "orders").select(F.concat(F.lit("K"), _t(customer)).alias("callee"), F.lit(0).alias("position"), text.alias("text"))
    sets = table(spark, sf_dir, "customer").where("c_custkey % 7 = 0").select(F.concat(F.lit("K"), _t("c_custkey")).alias("callee"), F.lit(0).alias("position"), F.concat(F.lit("f"), _t("c_nationkey")).alias("field"))
    nation = table(spark, sf_dir, "nation")
    getters = nation.select(F.concat(F.lit("n"), _t("n_nationkey")).alias("name"), F.concat(F.lit("f"), _t("n_nationkey")).alias("field"))
    options = nation.where("n_nationkey < 5").select(F.concat(F.lit("PREF_N"), _t("n_nationkey")).alias("name"), _t("n_regionkey").alias("value"))
    return constants.traced_parameters(arguments, sets, getters, options)


@query(
    "planned_callees",
    f"""WITH d AS (SELECT 'm' || (p_partkey % 97) AS name, 'src/' || p_brand || '/' || (p_size % 4) || '.c' AS file, 'src/' || p_brand AS folder, p_partkey AS o, (p_partkey % 1000)::INTEGER AS first_line, p_size % 9 + 1 AS n FROM part),
    e AS (SELECT l_orderkey AS report, n AS step, 'm' || (l_partkey % 100) AS callee, 'src/Brand#' || (l_suppkey % 5 + 1) || '1/' || (l_suppkey % 4) || '.c' AS file FROM ({_NUMBERED_SQL}) WHERE l_returnflag <> 'N'),
    c AS (SELECT report, callee, min(step) AS step, arg_min(file, step) AS hint FROM e GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY report ORDER BY step, callee)::INTEGER AS place FROM c),
    b AS (SELECT report, place, callee, arg_min(struct_pack(f := d.file, l := first_line, n := n), (CASE WHEN d.file = hint THEN 0 WHEN folder = hint THEN 1 WHEN folder = regexp_replace(hint, '/?[^/]*$', '') THEN 2 ELSE 3 END, o)) AS x
        FROM r JOIN d ON d.name = r.callee WHERE place <= 3 GROUP BY 1, 2, 3),
    s AS (SELECT report, place, callee, x.f AS file, x.l AS first_line, least(x.n, 6)::BIGINT AS n_lines, x.n > 6 AS cut, sum(least(x.n, 6)) OVER (PARTITION BY report ORDER BY place ROWS UNBOUNDED PRECEDING) AS total FROM b)
    SELECT report, place, callee, file, first_line, n_lines, cut FROM s WHERE total <= 12""",
)
def planned_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order as calls of methods that parts define: three functions, six lines of each, twelve in all."""
    supplier = F.col("l_suppkey")
    file = F.concat(F.lit("src/Brand#"), _t(supplier % 5 + 1), F.lit("1/"), _t(supplier % 4), F.lit(".c"))
    events = _numbered(spark, sf_dir).where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("report"), F.col("n").alias("step"), F.concat(F.lit("m"), _t(F.col("l_partkey") % 100)).alias("callee"), file.alias("file"))
    first = (F.col("p_partkey") % 1000).cast("int")
    definitions = table(spark, sf_dir, "part").select(
        F.concat(F.lit("m"), _t(F.col("p_partkey") % 97)).alias("name"), F.concat(F.lit("src/"), "p_brand", F.lit("/"), _t(F.col("p_size") % 4), F.lit(".c")).alias("file"), F.col("p_partkey").alias("ordinal"), first.alias("first_line"), (first + F.col("p_size") % 9).alias("last_line")
    )
    return callees.planned_callees(events, definitions, most_functions=3, most_lines=6, total_lines=12)


@query(
    "selected_segments",
    """WITH RECURSIVE o AS (SELECT o_custkey AS report, o_orderpriority AS segment, o_orderkey::VARCHAR AS candidate, o_orderkey AS k, o_orderstatus AS s, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS rank,
        dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS place FROM orders),
    n AS (SELECT report, max(place) AS n FROM o GROUP BY report),
    w(report, place, picks, ranks) AS (SELECT report, 0::BIGINT, []::VARCHAR[], []::BIGINT[] FROM n
        UNION ALL SELECT o.report, o.place, list_append(picks, o.candidate), list_append(ranks, o.rank) FROM w JOIN o ON o.report = w.report AND o.place = w.place + 1
        WHERE NOT EXISTS (SELECT 1 FROM o AS p WHERE p.report = o.report AND p.place < o.place AND p.candidate = picks[p.place] AND p.s = o.s AND (p.k + o.k) % 3 = 0)),
    b AS (SELECT w.report, arg_min(picks, ranks) AS picks FROM w JOIN n ON n.report = w.report AND n.n = w.place GROUP BY w.report)
    SELECT o.report, 'found' AS verdict, segment, candidate, rank FROM b JOIN o ON o.report = b.report AND o.candidate = picks[o.place]
    UNION ALL SELECT report, 'infeasible', NULL, NULL, NULL FROM n WHERE report NOT IN (SELECT report FROM b)""",
)
def selected_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's priorities as segments, the orders as their candidates; two of one status can't stand together if three
    divides the sum of their numbers."""
    orders = table(spark, sf_dir, "orders")
    rank = F.row_number().over(Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderkey")).cast("long")
    candidates = orders.select(F.col("o_custkey").alias("report"), F.col("o_orderpriority").alias("segment"), _t("o_orderkey").alias("candidate"), rank.alias("rank"))
    side = lambda a, b, c: orders.select(F.col("o_custkey").alias("report"), "o_orderstatus", F.pmod(F.col("o_orderkey") * c, F.lit(3)).alias("third"), F.col("o_orderpriority").alias(a), _t("o_orderkey").alias(b))
    pairs = side("segment", "candidate", 1).join(side("other_segment", "other_candidate", -1), ["report", "o_orderstatus", "third"]).where("segment < other_segment")
    return selection.select_segments(candidates, pairs).select("report", "verdict", "segment", "candidate", "rank")


_SAID_SQL = """said AS (SELECT event_id, user_id, 's' || (user_id % 100 + 1) AS file, event_type AS t, floor(coalesce(value, 0))::BIGINT % 25 AS v FROM events)"""


def _said():
    number = _t(F.floor(F.coalesce("value", F.lit(0.0))).cast("long") % 25)
    worded = F.when(F.col("event_type") == "click", "equal to ").when(F.col("event_type") == "view", "<= ").when(F.col("event_type") == "purchase", "> ").otherwise("not equal to ")
    return F.concat(F.lit("Assuming 'x' is "), worded, number)


@query(
    "short_circuits",
    f"""WITH {_SAID_SQL}, c AS (SELECT 's' || s_suppkey AS file, s_suppkey % 3 AS form, s_nationkey AS n FROM supplier)
    SELECT event_id AS report_key, file, 3 AS line, CASE WHEN form = 0 THEN 'first operand is true' ELSE 'first operand is false' END AS reason FROM said JOIN c USING (file)
    WHERE (form = 0 AND ((t = 'click' AND v > n) OR (t = 'purchase' AND v >= n))) OR (form = 1 AND CASE t WHEN 'click' THEN v <> n WHEN 'view' THEN n > v WHEN 'purchase' THEN n <= v ELSE v = n END)""",
)
def short_circuits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as assumptions about x at a supplier's condition of two operands on two lines."""
    form, n = F.col("s_suppkey") % 3, _t("s_nationkey")
    condition = F.when(form == 0, F.concat(F.lit("x > "), n, F.lit(" || y"))).when(form == 1, F.concat(F.lit("x == "), n, F.lit(" && y"))).otherwise(F.concat(F.lit("z == "), n, F.lit(" && y")))
    by = F.when(form == 0, "||").otherwise("&&")
    operands = F.array(F.struct(F.lit(2).alias("line"), F.lit("").alias("joined_by")), F.struct(F.lit(3).alias("line"), by.alias("joined_by")))
    controls = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), _t("s_suppkey")).alias("file"), condition.alias("condition"), operands.alias("operands"))
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("report_key"), F.concat(F.lit("s"), _t(F.col("user_id") % 100 + 1)).alias("file"), F.lit(2).alias("line"), _said().alias("message"))
    return structure.short_circuits(events, controls)


@query(
    "implicit_false",
    f"""WITH {_SAID_SQL}, e AS (SELECT said.*, row_number() OVER (PARTITION BY said.user_id ORDER BY ts, said.event_id) AS step, said.event_id % 12 AS line FROM said JOIN events ON events.event_id = said.event_id),
    c AS (SELECT 's' || s_suppkey AS file, s_nationkey AS n, s_suppkey % 4 + 2 AS line, s_suppkey % 4 + 3 AS low, s_suppkey % 4 + 3 + s_nationkey % 4 AS high FROM supplier),
    a AS (SELECT e.user_id, e.file, e.line, e.step, low, high, CASE t WHEN 'click' THEN v <= n WHEN 'view' THEN v <= n ELSE false END AS refuted FROM e JOIN c USING (file, line)
        WHERE t <> 'purchase' AND NOT EXISTS (SELECT 1 FROM e AS o WHERE o.user_id = e.user_id AND o.file = e.file AND o.line = e.line AND o.t = 'purchase')),
    f AS (SELECT a.*, (SELECT arg_min(o.line, o.step) FROM e AS o WHERE o.user_id = a.user_id AND o.step > a.step AND o.line >= low AND o.line > 0) AS following FROM a)
    SELECT user_id AS report_key, file, line, min(step) AS step FROM f WHERE refuted OR coalesce(following > high, false) GROUP BY ALL""",
)
def implicit_false(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as a path: purchases are stated decisions, others assume something about a supplier's condition or walk on."""
    supplier = F.col("s_suppkey")
    controls = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), _t(supplier)).alias("file"), (supplier % 4 + 2).alias("line"), F.concat(F.lit("x > "), _t("s_nationkey")).alias("condition"), (supplier % 4 + 3).alias("body_start"), (supplier % 4 + 3 + F.col("s_nationkey") % 4).alias("body_end")
    )
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    kind = F.when(F.col("event_type") == "purchase", "control").otherwise("event")
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("report_key"), step.alias("step"), kind.alias("kind"), F.concat(F.lit("s"), _t(F.col("user_id") % 100 + 1)).alias("file"), (F.col("event_id") % 12).alias("line"), _said().alias("message"))
    return structure.implicit_false(events, controls)


@query(
    "graph_coverage",
    f"""WITH r AS (SELECT l_orderkey AS report, n AS ordinal, CASE WHEN l_tax < 0.01 THEN NULL ELSE 's' || l_suppkey || '.c' END AS file FROM ({_NUMBERED_SQL})),
    f AS (SELECT report, file, row_number() OVER (PARTITION BY report ORDER BY ordinal, file) AS place FROM (SELECT report, file, min(ordinal) AS ordinal FROM r WHERE file IS NOT NULL GROUP BY 1, 2)),
    t AS (SELECT 's' || s_suppkey || '.c' AS file, ['parsed', 'partial', 'retry', 'failed'][s_suppkey % 4 + 1] AS status FROM supplier),
    k AS (SELECT report, file, status FROM f LEFT JOIN t USING (file) WHERE place <= 3),
    d AS (SELECT 's' || (p_partkey % 100 + 1) || '.c' AS file, count(*) AS n FROM part GROUP BY 1),
    g AS (SELECT report, sum(n)::BIGINT AS n FROM k JOIN d USING (file) WHERE status IN ('parsed', 'partial') GROUP BY 1),
    c AS (SELECT report, count(*) AS files, count(*) FILTER (status IN ('parsed', 'partial')) AS usable, count(*) FILTER (status = 'failed') AS failed FROM k GROUP BY 1)
    SELECT r.report, coalesce(any_value(files), 0) AS files, coalesce(any_value(usable), 0) AS usable, coalesce(any_value(failed), 0) AS failed, count(*) FILTER (file IS NULL) AS unresolved, coalesce(any_value(g.n), 0) AS functions
    FROM r LEFT JOIN c ON c.report = r.report LEFT JOIN g ON g.report = r.report GROUP BY r.report""",
)
def graph_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reports that point at suppliers' files, of which some are parsed; parts are the functions in them."""
    file = F.concat(F.lit("s"), _t("l_suppkey"), F.lit(".c"))
    references = _numbered(spark, sf_dir).select(F.col("l_orderkey").alias("report"), F.col("n").alias("ordinal"), F.when(F.col("l_tax") >= 0.01, file).alias("file"))
    kinds = F.array(*[F.lit(s) for s in ("parsed", "partial", "retry", "failed")])
    statuses = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), _t("s_suppkey"), F.lit(".c")).alias("file"), F.element_at(kinds, (F.col("s_suppkey") % 4 + 1).cast("int")).alias("status"))
    functions = table(spark, sf_dir, "part").select(F.concat(F.lit("s"), _t(F.col("p_partkey") % 100 + 1), F.lit(".c")).alias("file"), F.concat(F.lit("m"), _t(F.col("p_partkey") % 40)).alias("name"), (F.col("p_partkey") % 50).alias("first_line"), (F.col("p_partkey") % 50 + 3).alias("last_line"))
    files = graph_state.report_files(references, 3)
    return graph_state.graph_summary(references, files, statuses, graph_state.report_graph(files, statuses, functions))
