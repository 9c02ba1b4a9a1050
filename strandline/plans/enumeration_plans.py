"""Enumeration and ranking queries over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import enumeration as E
from strandline.plans.registry import query
from strandline.session import table


@query(
    "candidates_topk",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber, l_extendedprice, l_partkey, l_suppkey) AS rank FROM lineitem) WHERE rank <= 3""",
)
def candidates_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.top_candidates(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_quantity", "l_linenumber", "l_extendedprice"], ["l_partkey", "l_suppkey"], 3)
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "rank")


@query(
    "mutual_exclusion",
    """WITH g AS (SELECT l_orderkey, l_suppkey % 3 AS g, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS t, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT l_orderkey, sum(n)::BIGINT AS n_decisions FROM g GROUP BY l_orderkey HAVING max(t) < 2""",
)
def mutual_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("g", F.col("l_suppkey") % 3)
    return E.mutually_exclusive(rows, "l_orderkey", "g", F.col("l_returnflag") == "R")


@query(
    "postcondition_fallback",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, max(CASE WHEN l_quantity >= 45 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey) AS any_kept FROM lineitem) WHERE any_kept = 0 OR l_quantity >= 45""",
)
def postcondition_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.keep_all_if_empty(table(spark, sf_dir, "lineitem"), "l_orderkey", F.col("l_quantity") >= 45).select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    "bounded_combos",
    """WITH d AS (SELECT count(DISTINCT p_size)::BIGINT AS a, count(DISTINCT p_brand)::BIGINT AS b, count(DISTINCT p_type)::BIGINT AS c FROM part),
    x AS (SELECT i.range AS combo, (i.range // (b * c)) % a AS r0, (i.range // c) % b AS r1, i.range % c AS r2 FROM d, range(200000) i WHERE i.range < a * b * c)
    SELECT combo, [r0, r1, r2]::INTEGER[] AS ranks, (r0 + r1 + r2)::INTEGER AS rank_sum FROM x ORDER BY rank_sum, combo LIMIT 16""",
)
def bounded_combos(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "part").agg(F.count_distinct("p_size"), F.count_distinct("p_brand"), F.count_distinct("p_type")).first()
    return E.bounded_combinations(spark, list(sizes), given_out=16)


@query(
    "exploration_budget",
    """WITH n AS (SELECT l_orderkey, count(*)::BIGINT AS bound FROM lineitem GROUP BY l_orderkey) SELECT *, least(bound, 5) AS attempts, bound > 1 AND least(bound, 5) = bound AS exhausted FROM n""",
)
def exploration_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.exploration_budget(table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("bound")), "bound", requested=5)


@query(
    "cause_invariance",
    """SELECT l_orderkey, count(DISTINCT l_suppkey % 10)::BIGINT AS n_suppliers, count(DISTINCT l_linenumber)::BIGINT AS n_options, count(DISTINCT l_suppkey % 10) <= 1 AS invariant FROM lineitem GROUP BY l_orderkey""",
)
def cause_invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.cause_invariance(table(spark, sf_dir, "lineitem").withColumn("s", F.col("l_suppkey") % 10), "l_orderkey", "l_linenumber", "s")


@query(
    "layered_tags",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN 'contradictory' WHEN l_discount > 0.08 THEN 'consistent' WHEN l_tax = 0 THEN 'contradictory' WHEN l_linestatus = 'O' THEN 'consistent' ELSE 'insufficient_info' END AS verdict,
    CASE WHEN l_returnflag = 'R' THEN 'dead_range' WHEN l_discount > 0.08 THEN 'direct' WHEN l_tax = 0 THEN 'return_value' WHEN l_linestatus = 'O' THEN 'reachability' END AS layer FROM lineitem""",
)
def layered_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = [
        ("dead_range", F.when(F.col("l_returnflag") == "R", "contradictory")), ("direct", F.when(F.col("l_discount") > 0.08, "consistent")),
        ("return_value", F.when(F.col("l_tax") == 0, "contradictory")), ("reachability", F.when(F.col("l_linestatus") == "O", "consistent")),
    ]
    return E.first_decisive(table(spark, sf_dir, "lineitem"), layers).select("l_orderkey", "l_linenumber", "l_partkey", "verdict", "layer")
