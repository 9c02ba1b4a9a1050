"""Aggregation queries over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import aggregates as A
from strandline.plans.registry import query
from strandline.session import table


@query(
    "immediate_conflicts",
    """SELECT l_orderkey AS subject, list_sort(list(DISTINCT l_returnflag)) AS "values", count(*)::BIGINT AS n_facts
    FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) > 1""",
)
def immediate_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.immediate_conflicts(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag")


@query(
    "domain_facts_topk",
    """SELECT p_brand AS variable, count(DISTINCT p_size)::BIGINT AS n_constants, min(p_partkey) AS first_place, count(*)::BIGINT AS n_leaves
    FROM part GROUP BY p_brand HAVING count(DISTINCT p_size) >= 2 ORDER BY n_constants DESC, first_place, variable LIMIT 5""",
)
def domain_facts_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.domain_facts(table(spark, sf_dir, "part"), "p_brand", "p_size", "p_partkey", limit=5)


@query(
    "domain_facts_names",
    """SELECT p_name AS variable, count(DISTINCT p_size)::BIGINT AS n_constants, min(p_partkey) AS first_place, count(*)::BIGINT AS n_leaves
    FROM part GROUP BY p_name HAVING count(DISTINCT p_size) >= 2""",
)
def domain_facts_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.domain_facts(table(spark, sf_dir, "part"), "p_name", "p_size", "p_partkey")


@query(
    "return_compat",
    """SELECT l_orderkey, count(*)::BIGINT AS n_values, CASE WHEN bool_and(l_quantity >= 10) THEN 'consistent'
    WHEN NOT bool_or(l_quantity >= 10) THEN 'contradictory' ELSE 'insufficient_info' END AS verdict FROM lineitem GROUP BY l_orderkey""",
)
def return_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.all_none_mixed(table(spark, sf_dir, "lineitem"), "l_orderkey", F.col("l_quantity") >= 10)


@query(
    "relevance_reduce",
    """WITH s AS (SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT (l_suppkey % 7)::VARCHAR || ':' || l_returnflag) FILTER (l_suppkey % 7 < 4)), ',') AS sig
    FROM lineitem GROUP BY l_orderkey)
    SELECT coalesce(sig, '') AS signature, min(l_orderkey) AS representative, count(*)::BIGINT AS class_size FROM s GROUP BY 1""",
)
def relevance_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = F.col("l_suppkey") % 7
    return A.reduce_by_relevance(table(spark, sf_dir, "lineitem"), "l_orderkey", node.cast("string"), F.col("l_returnflag"), node < 4)


@query(
    "ci_groups",
    """WITH s AS (SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS elements, count(*)::BIGINT AS n_rows FROM orders GROUP BY o_custkey)
    SELECT elements, n_rows, count(*)::BIGINT AS n_members, min(o_custkey) AS first_member FROM s GROUP BY ALL HAVING count(*) > 1""",
)
def ci_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.equal_set_groups(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")


@query(
    "path_bound",
    """SELECT l_orderkey, count(*)::BIGINT AS n_segments, round(sum(log10(greatest(l_linenumber, 1))), 6) AS log10_bound,
    CASE WHEN sum(log10(greatest(l_linenumber, 1))) < 15 THEN round(product(greatest(l_linenumber, 1)))::BIGINT END AS bound FROM lineitem GROUP BY l_orderkey""",
)
def path_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.path_bound(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query(
    "verdict_aggregate",
    """WITH o AS (SELECT source, quality, toxic FROM labels JOIN documents USING (doc_id)),
    s AS (SELECT source, sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END)::BIGINT AS n_fp, sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END)::BIGINT AS n_tp, count(*)::BIGINT AS n_attempts FROM o GROUP BY source)
    SELECT *, CASE WHEN n_tp > 0 THEN 'TP' WHEN n_fp >= least(2, n_attempts) THEN 'FP' ELSE 'UNKNOWN' END AS verdict FROM s""",
)
def verdict_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return A.aggregate_verdicts(seen, "source", F.col("quality") == 0, F.col("toxic") == 1)


@query(
    "eval_confusion",
    """WITH j AS (SELECT CASE WHEN quality = 1 THEN 'FP' ELSE 'TP' END AS truth, CASE WHEN n_chars < 500 THEN 'TP' WHEN n_chars > 3000 THEN 'FP' ELSE 'UNKNOWN' END AS verdict
    FROM labels JOIN documents USING (doc_id)),
    k AS (SELECT CASE WHEN verdict = 'UNKNOWN' THEN 'UNDECIDED' WHEN verdict = truth THEN 'CORRECT' ELSE 'WRONG' END AS judgement FROM j)
    SELECT judgement, count(*)::BIGINT AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM k GROUP BY judgement""",
)
def eval_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    truth = F.when(F.col("quality") == 1, "FP").otherwise("TP")
    verdict = F.when(F.col("n_chars") < 500, "TP").when(F.col("n_chars") > 3000, "FP").otherwise("UNKNOWN")
    return A.confusion(seen.select(truth.alias("truth"), verdict.alias("verdict")), "truth", "verdict")


@query(
    "audit_expand",
    """SELECT l_orderkey, count(*)::BIGINT AS n_steps, count(DISTINCT l_linenumber)::BIGINT AS n_distinct, max(l_linenumber) AS highest,
    count(*) = count(DISTINCT l_linenumber) AND max(l_linenumber) = count(*) AS conforms FROM lineitem GROUP BY l_orderkey""",
)
def audit_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.conformance_audit(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query(
    "macro_statistics",
    """SELECT p_brand, count(*)::BIGINT AS n_nodes, sum(CASE WHEN p_type LIKE '%BRASS%' THEN 1 ELSE 0 END)::BIGINT AS n_macro,
    round(sum(CASE WHEN p_type LIKE '%BRASS%' THEN 1 ELSE 0 END) / count(*), 3) AS ratio FROM part GROUP BY p_brand""",
)
def macro_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.macro_statistics(table(spark, sf_dir, "part"), "p_brand", F.col("p_type").like("%BRASS%"))


@query(
    "batch_summary",
    """SELECT source, count(*)::BIGINT AS n_reports, sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END)::BIGINT AS n_tp, sum(CASE WHEN quality = 0 AND toxic = 0 THEN 1 ELSE 0 END)::BIGINT AS n_fp,
    sum(CASE WHEN toxic IS NULL OR (quality = 1 AND toxic = 0) THEN 1 ELSE 0 END)::BIGINT AS n_unknown FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""",
)
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict counts of a batch; a report without observation is UNKNOWN, never dropped."""
    seen = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    n = lambda test: F.sum(F.when(test, 1).otherwise(0))
    return seen.groupBy("source").agg(
        F.count("*").alias("n_reports"), n(F.col("toxic") == 1).alias("n_tp"), n((F.col("quality") == 0) & (F.col("toxic") == 0)).alias("n_fp"),
        n(F.col("toxic").isNull() | ((F.col("quality") == 1) & (F.col("toxic") == 0))).alias("n_unknown"),
    )
