"""Operators on ordered traces: segments, carried state, attribution and merged windows.

Every window is partitioned by the trace's key, so traces are independent of one another and spread over the cluster.
Ties are broken by the last ordering column, which must make the order total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _upto(key: str, order: list[str]):
    return Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before(key: str, order: list[str]):
    return Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def segment_trace(events: DataFrame, key: str, order: list[str], boundary: Column, event: str) -> DataFrame:
    """Cut a trace after every boundary event: key, segment_index, first_event, last_event, n_events, closed (it ends in a boundary)."""
    marked = events.withColumn("_b", F.coalesce(boundary, F.lit(False)).cast("int"))
    numbered = marked.withColumn("segment_index", F.coalesce(F.sum("_b").over(_before(key, order)), F.lit(0)))
    place = F.struct(*order, F.col(event).alias("_event"))
    return numbered.groupBy(key, "segment_index").agg(
        F.min(place)["_event"].alias("first_event"), F.max(place)["_event"].alias("last_event"), F.count("*").alias("n_events"), (F.max("_b") == 1).alias("closed")
    )


def precondition_tail(events: DataFrame, key: str, order: list[str], boundary: Column, event: str, most: int = 6) -> DataFrame:
    """The last so many events before each boundary event that are none themselves, in order: key, boundary_event, facts."""
    marked = events.withColumn("_b", F.coalesce(boundary, F.lit(False)))
    recent = Window.partitionBy(key).orderBy(*order).rowsBetween(-most, -1)
    kept = F.collect_list(F.when(~F.col("_b"), F.col(event))).over(recent)
    return marked.withColumn("facts", kept).where("_b").select(key, F.col(event).alias("boundary_event"), "facts")


def asof_attribution(events: DataFrame, key: str, order: list[str], marker: Column, event: str) -> DataFrame:
    """Each event that is no marker with the last marker before it, null if there is none: key, event, marker_event."""
    marked = events.withColumn("_m", F.coalesce(marker, F.lit(False)))
    last = F.last(F.when(F.col("_m"), F.col(event)), ignorenulls=True).over(_before(key, order))
    return marked.withColumn("marker_event", last).where("NOT _m").select(key, F.col(event).alias("event"), "marker_event")


def call_depth(events: DataFrame, key: str, order: list[str], push: Column, pop: Column) -> DataFrame:
    """The events with depth, the call stack's height after each; a pop at the root changes nothing.

    With the running sum s of +1 and -1 and its least value so far m (0 at most), the height is s - m."""
    step = F.when(push, 1).when(pop, -1).otherwise(0)
    summed = events.withColumn("_s", F.sum(step).over(_upto(key, order)))
    least = F.least(F.lit(0), F.min("_s").over(_upto(key, order)))
    return summed.withColumn("depth", F.col("_s") - least).drop("_s")


def caller_of(events: DataFrame, key: str, order: list[str], push: Column, pop: Column, name: str) -> DataFrame:
    """callee -> caller of each trace: the innermost open frame when a call is made; the last call of a callee wins. Calls from the root have a null caller.

    The caller of a push to depth d is the last push to depth d - 1 before it."""
    deep = call_depth(events, key, order, push, pop).withColumn("_push", F.coalesce(push, F.lit(False))).where("_push")
    left = deep.select(key, *order, F.col(name).alias("callee"), F.col("depth").alias("_d"), (F.col("depth") - 1).alias("_up"))
    both = left.select(key, *order, "callee", F.col("_up").alias("_level"), F.lit(True).alias("_asks")).unionByName(
        left.select(key, *order, "callee", F.col("_d").alias("_level"), F.lit(False).alias("_asks"))
    )
    w = Window.partitionBy(key, "_level").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("caller", F.last(F.when(~F.col("_asks"), F.col("callee")), ignorenulls=True).over(w)).where("_asks")
    return found.groupBy(key, "callee").agg(F.max(F.struct(*order, F.struct("caller").alias("v")))["v"]["caller"].alias("caller"), F.count("*").alias("n_calls"))


def merge_windows(points: DataFrame, key: str, at: str, before: int, after: int) -> DataFrame:
    """Windows [at - before, at + after] of a key, merged where they touch or overlap: key, low, high, n_points."""
    spans = points.select(key, (F.col(at) - before).alias("low"), (F.col(at) + after).alias("high"))
    reach = F.max("high").over(_before(key, ["low", "high"]))
    fresh = spans.withColumn("_new", F.when(reach.isNull() | (F.col("low") > reach + 1), 1).otherwise(0))
    island = fresh.withColumn("_island", F.sum("_new").over(_upto(key, ["low", "high"])))
    return island.groupBy(key, "_island").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("n_points")).drop("_island")


def reaching_definitions_straight(events: DataFrame, key: str, order: list[str], definition: Column, use: Column, event: str) -> DataFrame:
    """The definition that reaches each use on a straight trace: key, use_event, def_event (null if none does)."""
    last = F.last(F.when(definition, F.col(event)), ignorenulls=True).over(_before(key, order))
    return events.withColumn("def_event", last).where(use).select(key, F.col(event).alias("use_event"), "def_event")


def accumulate_state(events: DataFrame, key: str, order: list[str], variable: str, value: str) -> DataFrame:
    """The final state of a trace: each variable with its last value and how often it was set."""
    place = F.struct(*order, F.col(value).alias("_v"))
    return events.groupBy(key, variable).agg(F.max(place)["_v"].alias("value"), F.count("*").alias("n_writes"))
