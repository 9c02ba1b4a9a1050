"""Fix-point queries over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators import graph as G
from strandline.plans.registry import query
from strandline.session import table


def _flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directed graph of parts: from each line of an order to the next one's."""
    lines = table(spark, sf_dir, "lineitem")
    after = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    return lines.select(F.col("l_partkey").alias("src"), after.alias("dst")).where("src <> dst").distinct()


_FLOW_SQL = "SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem) WHERE src <> dst"


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each order with their number n in it, as line numbers recur."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(w).cast("long"))


_NUMBERED_SQL = "SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem"


def _functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as functions, their lines as blocks: each goes on to the next, returned ones may skip it, filled ones may go
    back to the first, and the last one goes to the exit, block 0."""
    rows = _numbered(spark, sf_dir).withColumn("_last", F.max("n").over(Window.partitionBy("l_orderkey")))
    n, last = F.col("n"), F.col("_last")
    within = lambda to: F.when(to <= last, to).otherwise(F.lit(0).cast("long"))
    targets = F.array(within(n + 1), F.when(F.col("l_returnflag") == "R", within(n + 2)), F.when(F.col("l_linestatus") == "F", F.lit(1).cast("long")))
    return rows.select(F.col("l_orderkey").alias("function"), n.alias("src"), F.explode(F.array_compact(targets)).alias("dst")).distinct()


_FUNCTIONS_SQL = f"""r AS (SELECT l_orderkey AS f, n, l_returnflag AS g, l_linestatus AS s, max(n) OVER (PARTITION BY l_orderkey) AS last FROM ({_NUMBERED_SQL})),
    e AS (SELECT DISTINCT * FROM (SELECT f, n AS src, CASE WHEN n + 1 <= last THEN n + 1 ELSE 0 END AS dst FROM r UNION ALL SELECT f, n, CASE WHEN n + 2 <= last THEN n + 2 ELSE 0 END FROM r WHERE g = 'R' UNION ALL SELECT f, n, 1 FROM r WHERE s = 'F'))"""


@query(
    "backward_slice",
    """WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS dst, 'r' || n_regionkey AS src FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders),
    w AS (SELECT 'o' || o_orderkey AS node, 0 AS depth FROM orders WHERE o_totalprice > 300000 UNION SELECT e.src, depth + 1 FROM w JOIN e ON e.dst = w.node)
    SELECT node, min(depth) AS depth FROM w GROUP BY node""",
)
def backward_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda letter, column: F.concat(F.lit(letter), F.col(column).cast("string"))
    edges = (
        table(spark, sf_dir, "nation").select(name("n", "n_nationkey").alias("dst"), name("r", "n_regionkey").alias("src"))
        .unionByName(table(spark, sf_dir, "customer").select(name("c", "c_custkey").alias("dst"), name("n", "c_nationkey").alias("src")))
        .unionByName(table(spark, sf_dir, "orders").select(name("o", "o_orderkey").alias("dst"), name("c", "o_custkey").alias("src")))
    )
    seeds = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(name("o", "o_orderkey").alias("node"))
    return G.backward_slice(edges, seeds)


@query(
    "cfg_reachability",
    f"""WITH RECURSIVE e AS ({_FLOW_SQL}), w AS (SELECT min(src) AS node FROM e UNION SELECT e.dst FROM w JOIN e ON e.src = w.node),
    n AS (SELECT src AS node FROM e UNION SELECT dst FROM e)
    SELECT n.node, w.node IS NOT NULL AS reachable FROM n LEFT JOIN w USING (node)""",
)
def cfg_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = G.settle(_flow(spark, sf_dir))
    found = G.reach(flow, flow.agg(F.min("src").alias("node")), max_depth=None).select("node", F.lit(True).alias("_r"))
    nodes = flow.select(F.col("src").alias("node")).unionByName(flow.select(F.col("dst").alias("node"))).distinct()
    return nodes.join(found, "node", "left").select("node", F.coalesce("_r", F.lit(False)).alias("reachable"))


@query(
    "control_dependence",
    f"""WITH RECURSIVE {_FUNCTIONS_SQL}, v AS (SELECT f, src AS n FROM e UNION SELECT f, dst FROM e),
    x(f, n, d) AS (SELECT f, 0::BIGINT, n FROM v WHERE n <> 0 UNION SELECT e.f, e.src, x.d FROM x JOIN e ON e.f = x.f AND e.dst = x.n WHERE e.src <> x.d),
    dom AS (SELECT a.f, a.n, b.n AS d FROM v AS a JOIN v AS b ON a.f = b.f ANTI JOIN x ON x.f = a.f AND x.n = a.n AND x.d = b.n)
    SELECT DISTINCT e.f AS "function", e.src AS controller, dom.d AS dependent FROM e JOIN dom ON dom.f = e.f AND dom.n = e.dst
    WHERE NOT EXISTS (SELECT 1 FROM dom AS o WHERE o.f = e.f AND o.n = e.src AND o.d = dom.d AND o.n <> o.d)""",
)
def control_dependence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control dependence in every function."""
    return G.control_dependence(_functions(spark, sf_dir), 0, "function")


@query(
    "reaching_definitions_loops",
    f"""WITH RECURSIVE {_FUNCTIONS_SQL}, b AS (SELECT l_orderkey AS f, n, l_partkey % 3 AS v FROM ({_NUMBERED_SQL})),
    m(f, n, v, d) AS (SELECT e.f, e.dst, b.v, b.n FROM e JOIN b ON b.f = e.f AND b.n = e.src UNION SELECT e.f, e.dst, m.v, m.d FROM m JOIN e ON e.f = m.f AND e.src = m.n JOIN b ON b.f = m.f AND b.n = m.n WHERE b.v <> m.v)
    SELECT f AS "function", n AS block, v AS variable, d AS definition FROM m""",
)
def reaching_definitions_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions, one of a variable in every block, that reach each block of their function, loops included."""
    blocks = _numbered(spark, sf_dir).select(F.col("l_orderkey").alias("function"), F.col("n").alias("block"), (F.col("l_partkey") % 3).alias("variable"))
    return G.reaching_definitions(blocks.withColumn("definition", F.col("block")), _functions(spark, sf_dir), "function")


@query(
    "control_closure_writes",
    """WITH RECURSIVE c AS (SELECT c_nationkey::BIGINT AS p, 100 + c_custkey AS n FROM customer UNION ALL SELECT DISTINCT 100 + o_custkey, 1000000 + o_orderkey FROM orders),
    x AS (SELECT 1000000 + o_orderkey AS node, o_orderpriority AS variable FROM orders UNION SELECT c.p, variable FROM x JOIN c ON c.n = x.node)
    SELECT DISTINCT p AS predicate, variable FROM c JOIN x ON x.node = c.p""",
)
def control_closure_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    control = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("predicate"), (100 + F.col("c_custkey")).alias("node")).unionByName(
        orders.select((100 + F.col("o_custkey")).alias("predicate"), (1000000 + F.col("o_orderkey")).alias("node"))
    )
    return G.closure_writes(control, orders.select((1000000 + F.col("o_orderkey")).alias("node"), F.col("o_orderpriority").alias("variable")))
