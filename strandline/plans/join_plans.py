"""Join and look-up queries over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import joins as J
from strandline.plans.registry import query
from strandline.session import table


@query(
    "contradictions",
    """WITH n AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n, value > 20 AS dir FROM events),
    c AS (SELECT * FROM n WHERE event_type <> 'error' AND dir IS NOT NULL)
    SELECT a.user_id, a.event_type, a.event_id AS first_event, b.event_id AS second_event FROM c a JOIN c b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.n = b.n AND (a.ts, a.event_id) < (b.ts, b.event_id) WHERE a.dir <> b.dir""",
)
def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.contradictions(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", F.col("value") > 20, F.col("event_type") == "error", "event_id")


@query(
    "kth_pairing",
    """WITH e AS (SELECT *, date_trunc('day', ts)::DATE AS day FROM events),
    n AS (SELECT user_id, day, event_type, event_id, row_number() OVER (PARTITION BY user_id, day, event_type ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id, day, event_type) AS n FROM e)
    SELECT a.user_id, strftime(a.day, '%Y-%m-%d') AS day, a.k::INTEGER AS k, a.event_id AS left_event, b.event_id AS right_event FROM n a JOIN n b USING (user_id, day, k, n) WHERE a.event_type = 'click' AND b.event_type = 'view'""",
)
def kth_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return J.kth_pairing(events.where("event_type = 'click'"), events.where("event_type = 'view'"), ["user_id", "day"], ["ts", "event_id"], "event_id", "event_id")


def _event_at():
    return F.floor("value").cast("long")


@query(
    "band_match",
    """WITH l AS (SELECT event_id, floor(value)::BIGINT AS pos FROM events WHERE value IS NOT NULL), p AS (SELECT DISTINCT pos FROM l),
    m AS (SELECT pos, CASE WHEN pos = p_size THEN 0 ELSE 1 END AS tier, count(*)::BIGINT AS n, min(p_partkey) AS f FROM p JOIN part ON abs(pos - p_size) <= 5 GROUP BY 1, 2),
    b AS (SELECT pos, min(tier) AS tier, arg_min(n, tier) AS n_matches, arg_min(f, tier) AS first_match FROM m GROUP BY pos)
    SELECT event_id, tier, n_matches, first_match FROM l JOIN b USING (pos)""",
)
def band_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "events").where("value IS NOT NULL").select("event_id", _event_at().alias("at"))
    return J.tiered_match(left, table(spark, sf_dir, "part"), "event_id", "at", "p_partkey", "p_size", 5)


@query(
    "nearest_node",
    """WITH l AS (SELECT event_id, floor(value)::BIGINT AS pos FROM events WHERE value IS NOT NULL), p AS (SELECT DISTINCT pos FROM l),
    m AS (SELECT pos, abs(pos - p_size) - CASE WHEN p_type LIKE '%BRASS%' THEN 1 ELSE 0 END AS score, p_partkey FROM p JOIN part ON abs(pos - p_size) <= 5),
    b AS (SELECT pos, arg_min(score, (score, p_partkey)) AS score, arg_min(p_partkey, (score, p_partkey)) AS match FROM m GROUP BY pos)
    SELECT event_id, score, match FROM l JOIN b USING (pos)""",
)
def nearest_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "events").where("value IS NOT NULL").select("event_id", _event_at().alias("at"))
    return J.nearest_match(left, table(spark, sf_dir, "part"), "event_id", "at", "p_partkey", "p_size", 5, (), F.col("p_type").like("%BRASS%"))


_HOST = r"://([^/?#]*)"


@query(
    "ranked_resolution",
    r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages),
    a AS (SELECT page_id, host, regexp_replace(host, '^[^.]*\.', '') AS parent FROM p), k AS (SELECT page_id AS t, host, regexp_replace(host, '^[^.]*\.', '') AS parent FROM p WHERE url LIKE 'https:%'),
    h AS (SELECT a.page_id, 0 AS strategy, min(t) AS target FROM a JOIN k ON a.host = k.host GROUP BY 1 UNION ALL SELECT a.page_id, 1, min(t) FROM a JOIN k ON a.parent = k.host GROUP BY 1
    UNION ALL SELECT a.page_id, 2, min(t) FROM a JOIN k ON a.parent = k.parent GROUP BY 1)
    SELECT a.page_id, coalesce(min(strategy), -1) AS strategy, arg_min(target, strategy) AS target FROM a LEFT JOIN h USING (page_id) GROUP BY a.page_id""",
)
def ranked_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", _HOST, 1).alias("host")).withColumn("parent", F.regexp_replace("host", r"^[^.]*\.", ""))
    rungs = [(F.col("host"), F.col("host")), (F.col("parent"), F.col("host")), (F.col("parent"), F.col("parent"))]
    return J.ranked_resolution(pages, pages.where("url LIKE 'https:%'"), "page_id", rungs, "page_id")


@query(
    "path_violations",
    """SELECT o_orderkey AS k, 'F' AS wanted, count(*)::BIGINT AS n_known FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' AND l_linestatus IS NOT NULL
    GROUP BY o_orderkey HAVING NOT bool_or(l_linestatus = 'F')""",
)
def path_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"), F.lit("F").alias("wanted"))
    actual = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linestatus").alias("seen"))
    return J.path_violations(expected, actual, "k", "wanted", "seen")


@query(
    "tightest_range",
    """WITH r AS (SELECT p_brand AS name, min(p_partkey) AS low, max(p_partkey) AS high FROM part GROUP BY p_brand),
    m AS (SELECT s_suppkey, name, (high - low)::BIGINT AS span FROM supplier JOIN r ON s_suppkey BETWEEN low AND high)
    SELECT s_suppkey, arg_min(name, (span, name)) AS name, min(span) AS span FROM m GROUP BY s_suppkey""",
)
def tightest_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(F.min("p_partkey").alias("low"), F.max("p_partkey").alias("high"))
    return J.tightest_range(table(spark, sf_dir, "supplier").select("s_suppkey"), ranges, "s_suppkey", "s_suppkey", "low", "high", "name")


@query(
    "interval_conflicts",
    """WITH s AS (SELECT o_custkey, o_orderpriority AS d, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY ALL)
    SELECT o_custkey, a.d AS first, b.d AS second, round(greatest(a.low, b.low) - least(a.high, b.high), 4) AS gap FROM s a JOIN s b USING (o_custkey)
    WHERE a.d < b.d AND greatest(a.low, b.low) > least(a.high, b.high)""",
)
def interval_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.interval_conflicts(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", F.col("o_totalprice"), F.col("o_totalprice"))


@query(
    "segment_conflict_pairs",
    """SELECT a.o_custkey, a.o_orderpriority, a.o_orderkey AS first_segment, b.o_orderkey AS second_segment FROM orders a JOIN orders b
    ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority AND a.o_orderkey < b.o_orderkey AND a.o_orderstatus <> b.o_orderstatus""",
)
def segment_conflict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.segment_conflicts(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus")


@query(
    "seed_union",
    """WITH u AS (SELECT l_orderkey AS k, 0 AS phase, 'returned' AS reason FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT o_orderkey, 1, 'urgent' FROM orders WHERE o_orderpriority = '1-URGENT'
    UNION ALL SELECT o_orderkey, 2, 'costly' FROM orders WHERE o_totalprice > 200000)
    SELECT k, arg_min(reason, phase) AS reason, min(phase) AS phase FROM u GROUP BY k""",
)
def seed_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    seeds = [
        table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"), F.lit("returned").alias("why")),
        orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("k"), F.lit("urgent").alias("why")),
        orders.where("o_totalprice > 200000").select(F.col("o_orderkey").alias("k"), F.lit("costly").alias("why")),
    ]
    return J.seed_union(seeds, ["k"], "why")


@query(
    "unique_call_resolution",
    """WITH k AS (SELECT p_name AS name, count(DISTINCT p_partkey) AS n, min(p_partkey) AS t FROM part GROUP BY p_name)
    SELECT p_partkey AS site, p_name AS name, CASE WHEN n = 1 THEN t END AS target, CASE WHEN n = 1 THEN 'syntactic' WHEN n > 1 THEN 'candidate' ELSE 'unresolved' END AS confidence FROM part JOIN k ON p_name = name""",
)
def unique_call_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return J.unique_match(part.select(F.col("p_partkey").alias("site"), F.col("p_name").alias("name")), part.select(F.col("p_name").alias("name"), "p_partkey"), "name", "p_partkey")


@query(
    "not_taken_prune",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'O')""",
)
def not_taken_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drop what hangs on a key annotated FALSE; keys without annotation stay."""
    refused = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(refused, "l_orderkey", "left_anti")


@query(
    "call_node_ladder",
    """WITH a AS (SELECT o_orderkey AS ask, CASE WHEN o_orderstatus = 'F' THEN 'ns' || (o_custkey % 50 + 1) || '::' ELSE '' END || 'fn' || o_custkey AS name,
    CASE WHEN o_orderstatus = 'O' THEN '' ELSE '#' || (o_custkey % 5 + 1) || (o_orderkey % 5 + 1) END AS file, o_orderkey % 1000 AS line FROM orders),
    n AS (SELECT 'ns' || p_size || '::fn' || p_partkey AS id, 'src/' || p_brand AS file, p_partkey % 1000 AS line, p_partkey AS ordinal FROM part),
    x AS (SELECT id AS name, arg_min(id, ordinal) AS e FROM n GROUP BY 1), s AS (SELECT split_part(id, '::', 2) AS name, arg_min(id, ordinal) AS s FROM n GROUP BY 1),
    q AS (SELECT DISTINCT file, line FROM a WHERE file <> ''), p AS (SELECT q.file, q.line, arg_min(id, ordinal) AS p FROM q JOIN n ON ends_with(n.file, q.file) AND abs(n.line - q.line) <= 5 GROUP BY 1, 2)
    SELECT ask, CASE WHEN e IS NOT NULL THEN 'exact' WHEN p IS NOT NULL THEN 'place' WHEN s IS NOT NULL THEN 'suffix' ELSE 'unresolved' END AS strategy, coalesce(e, p, s) AS node
    FROM a LEFT JOIN x USING (name) LEFT JOIN p USING (file, line) LEFT JOIN s USING (name)""",
)
def call_node_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reported functions, resolved against parts as call-graph nodes."""
    text = lambda c: c.cast("string")
    customer = F.col("o_custkey")
    qualified = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("ns"), text(customer % 50 + 1), F.lit("::"))).otherwise("")
    file = F.when(F.col("o_orderstatus") == "O", "").otherwise(F.concat(F.lit("#"), text(customer % 5 + 1), text(F.col("o_orderkey") % 5 + 1)))
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ask"), F.concat(qualified, F.lit("fn"), text(customer)).alias("name"), file.alias("file"), (F.col("o_orderkey") % 1000).alias("line"))
    nodes = table(spark, sf_dir, "part").select(
        F.concat(F.lit("ns"), text(F.col("p_size")), F.lit("::fn"), text(F.col("p_partkey"))).alias("id"), F.concat(F.lit("src/"), "p_brand").alias("file"),
        (F.col("p_partkey") % 1000).alias("line"), F.col("p_partkey").alias("ordinal"),
    )
    return J.call_nodes(asked, nodes)


@query(
    "linked_calls",
    """WITH c AS (SELECT event_id, user_id AS function, floor(value)::BIGINT AS line, event_type AS callee FROM events),
    n AS (SELECT o_custkey AS function, o_orderkey % 50 AS line, 'n' || max(o_orderkey) AS node FROM orders GROUP BY 1, 2)
    SELECT event_id, function, line, callee, node IS NULL AS synthesized,
    coalesce(node, 'call-' || substr(sha1(concat_ws('|', function::VARCHAR, line::VARCHAR, callee)), 1, 12)) AS node FROM c LEFT JOIN n USING (function, line)""",
)
def linked_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as call sites; each customer's orders as the nodes of a function."""
    calls = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("function"), _event_at().alias("line"), F.col("event_type").alias("callee"))
    nodes = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("function"), (F.col("o_orderkey") % 50).alias("line"), F.col("o_orderkey").alias("ordinal"), F.concat(F.lit("n"), F.col("o_orderkey").cast("string")).alias("id")
    )
    return J.linked_calls(calls, nodes)
