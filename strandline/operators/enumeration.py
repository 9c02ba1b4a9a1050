"""Bounded enumeration: candidate ranking, exclusivity, combinations of segments and cause invariance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed limits of the semantics: combinations looked at, and those given out.
LOOKED_AT = 200_000
GIVEN_OUT = 100_000


def top_candidates(df: DataFrame, segment: str, metric: Sequence[str], tie: Sequence[str], k: int) -> DataFrame:
    """The k candidates of each segment that are least by metric, then tie; adds rank from 1. The limit is the feature."""
    w = Window.partitionBy(segment).orderBy(*metric, *tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mutually_exclusive(decisions: DataFrame, candidate: str, group: str, taken: Column) -> DataFrame:
    """Candidates that take at most one branch of every exclusive group: candidate, n_decisions."""
    per = decisions.groupBy(candidate, group).agg(F.sum(F.when(taken, 1).otherwise(0)).alias("_t"), F.count("*").alias("_n"))
    return per.groupBy(candidate).agg(F.max("_t").alias("_worst"), F.sum("_n").alias("n_decisions")).where("_worst < 2").drop("_worst")


def keep_all_if_empty(df: DataFrame, segment: str, keep: Column) -> DataFrame:
    """Rows that satisfy keep; a segment of which none does keeps all of its rows."""
    kept = F.max(F.when(keep, 1).otherwise(0)).over(Window.partitionBy(segment))
    return df.withColumn("_any", kept).where((F.col("_any") == 0) | keep).drop("_any")


def bounded_combinations(spark, sizes: Sequence[int], looked_at: int = LOOKED_AT, given_out: int = GIVEN_OUT) -> DataFrame:
    """Of the first looked_at combinations in lexicographic order, the given_out with the least sum of ranks: combo, ranks, rank_sum.

    A combination is decoded from its number in the mixed radix of the sizes, so no product is formed. Ties go by number."""
    total = 1
    for n in sizes:
        total *= max(1, n)
    base, ranks = 1, []
    for n in reversed(sizes):
        ranks.append((F.floor(F.col("id") / base) % max(1, n)).cast("int"))
        base *= max(1, n)
    found = spark.range(min(total, looked_at)).select(F.col("id").alias("combo"), F.array(*reversed(ranks)).alias("ranks"))
    summed = found.withColumn("rank_sum", F.aggregate("ranks", F.lit(0), lambda s, r: s + r))
    return summed.orderBy("rank_sum", "combo").limit(given_out)


def exploration_budget(bounds: DataFrame, bound: str, requested: int = 10, most: int = 10) -> DataFrame:
    """attempts = least of bound, requested and most; exhausted if that covers a bound above 1."""
    attempts = F.least(F.col(bound), F.lit(requested), F.lit(most)).cast("long")
    return bounds.withColumns({"attempts": attempts, "exhausted": (F.col(bound) > 1) & (attempts == F.col(bound))})


def cause_invariance(choices: DataFrame, dimension: str, option: str, supplier: str) -> DataFrame:
    """Per dimension whether all of its options name one supplier of the cause, and a product that every dimension leaves alone.

    An option without a supplier is conservative: it counts as different from all others."""
    per = choices.groupBy(dimension).agg(F.count_distinct(supplier).alias("n_suppliers"), F.bool_or(F.col(supplier).isNull()).alias("_open"), F.count_distinct(option).alias("n_options"))
    return per.withColumn("invariant", (F.col("n_suppliers") <= 1) & ~F.col("_open")).drop("_open")


def first_decisive(df: DataFrame, layers: Sequence[tuple[str, Column]], default: str = "insufficient_info") -> DataFrame:
    """Adds verdict and layer of the first layer whose column isn't null: the others are not consulted. Null everywhere: the default, layer null."""
    verdict = F.coalesce(*[c for _, c in layers], F.lit(default))
    layer = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for n, c in layers])
    return df.withColumns({"verdict": verdict, "layer": layer})
