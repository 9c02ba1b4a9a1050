"""Grouping operators: conflicts, domain facts, compression of candidate sets and verdicts.

All are hash aggregations with map-side partial results; nothing gathers a group's rows in one place except where the
result is the set itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def immediate_conflicts(facts: DataFrame, subject: str, value: str) -> DataFrame:
    """Subjects that equality facts give more than one value: subject, values (sorted), n_facts. Null values say nothing."""
    return (
        facts.where(F.col(value).isNotNull())
        .groupBy(F.col(subject).alias("subject"))
        .agg(F.array_sort(F.collect_set(value)).alias("values"), F.count("*").alias("n_facts"))
        .where(F.size("values") > 1)
    )


def domain_facts(leaves: DataFrame, variable: str, constant: str, place: str, min_distinct: int = 2, limit: int | None = None) -> DataFrame:
    """Variables compared with at least so many distinct constants, the most first, then the earliest place."""
    found = (
        leaves.where(F.col(constant).isNotNull())
        .groupBy(F.col(variable).alias("variable"))
        .agg(F.countDistinct(constant).alias("n_constants"), F.min(place).alias("first_place"), F.count("*").alias("n_leaves"))
        .where(F.col("n_constants") >= min_distinct)
    )
    return found if limit is None else found.orderBy(F.desc("n_constants"), "first_place", "variable").limit(limit)


def all_none_mixed(df: DataFrame, key: str, test: Column) -> DataFrame:
    """Per key whether all, none or some of its returned values satisfy a postcondition: consistent, contradictory or insufficient_info."""
    return df.groupBy(key).agg(F.bool_and(test).alias("_all"), F.bool_or(test).alias("_any"), F.count("*").alias("n_values")).select(
        key, "n_values", F.when(F.col("_all"), "consistent").when(~F.col("_any"), "contradictory").otherwise("insufficient_info").alias("verdict")
    )


def reduce_by_relevance(decisions: DataFrame, candidate: str, node: Column, taken: Column, relevant: Column) -> DataFrame:
    """Candidates that agree on all relevant (node, direction) pairs become one class: signature, representative (the least), class_size."""
    per = decisions.groupBy(candidate).agg(F.array_sort(F.collect_set(F.when(relevant, F.concat_ws(":", node, taken)))).alias("_set"))
    return (
        per.withColumn("signature", F.concat_ws(",", "_set"))
        .groupBy("signature")
        .agg(F.min(candidate).alias("representative"), F.count("*").alias("class_size"))
    )


def equal_set_groups(df: DataFrame, member: str, element: str) -> DataFrame:
    """Members with the same set of elements and as many rows, where there are at least two: elements, n_rows, n_members, first_member."""
    per = df.groupBy(member).agg(F.concat_ws(",", F.array_sort(F.collect_set(element))).alias("elements"), F.count("*").alias("n_rows"))
    return per.groupBy("elements", "n_rows").agg(F.count("*").alias("n_members"), F.min(member).alias("first_member")).where("n_members > 1")


def path_bound(counts: DataFrame, report: str, n: str) -> DataFrame:
    """The number of paths of a report: the product of its segments' candidate counts, exact below 10^15 and as a logarithm always.

    A segment without candidates counts as one, as it doesn't restrict the path."""
    factor = F.greatest(F.col(n), F.lit(1)).cast("double")
    per = counts.groupBy(report).agg(F.sum(F.log10(factor)).alias("_log"), F.product(factor).alias("_product"), F.count("*").alias("n_segments"))
    return per.select(report, "n_segments", F.round("_log", 6).alias("log10_bound"), F.when(F.col("_log") < 15, F.round("_product").cast("long")).alias("bound"))


def aggregate_verdicts(df: DataFrame, group: str, false_positive: Column, true_positive: Column, attempts: Column | None = None) -> DataFrame:
    """One verdict per group of path observations: FP needs at least two (or all, if fewer) and no contrary one, TP one; else UNKNOWN."""
    per = df.groupBy(group).agg(
        F.sum(F.when(false_positive, 1).otherwise(0)).alias("n_fp"), F.sum(F.when(true_positive, 1).otherwise(0)).alias("n_tp"), F.count("*").alias("n_attempts")
    )
    return per.withColumn(
        "verdict", F.when(F.col("n_tp") > 0, "TP").when(F.col("n_fp") >= F.least(F.lit(2), "n_attempts"), "FP").otherwise("UNKNOWN")
    )


def confusion(df: DataFrame, truth: str, verdict: str) -> DataFrame:
    """Judgement counts of verdicts against the truth: CORRECT, WRONG, UNDECIDED (verdict UNKNOWN), with the share of all rows."""
    judged = F.when(F.col(verdict) == "UNKNOWN", "UNDECIDED").when(F.col(verdict) == F.col(truth), "CORRECT").otherwise("WRONG")
    per = df.groupBy(judged.alias("judgement")).agg(F.count("*").alias("n"))
    total = Window.partitionBy(F.lit(1))
    return per.withColumn("share", F.round(F.col("n") / F.sum("n").over(total), 6))


def conformance_audit(steps: DataFrame, key: str, index: str) -> DataFrame:
    """Whether a sparse list of step numbers covers 1..count exactly: n_steps, n_distinct, highest, conforms."""
    return steps.groupBy(key).agg(F.count("*").alias("n_steps"), F.countDistinct(index).alias("n_distinct"), F.max(index).alias("highest")).withColumn(
        "conforms", (F.col("n_steps") == F.col("n_distinct")) & (F.col("highest") == F.col("n_steps"))
    )


def macro_statistics(nodes: DataFrame, group: str, is_macro: Column) -> DataFrame:
    """Nodes and macro nodes per group, with their ratio to three places."""
    return nodes.groupBy(group).agg(F.count("*").alias("n_nodes"), F.sum(F.when(is_macro, 1).otherwise(0)).alias("n_macro")).withColumn(
        "ratio", F.round(F.col("n_macro") / F.col("n_nodes"), 3)
    )
