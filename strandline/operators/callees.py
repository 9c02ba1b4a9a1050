"""Sources of the functions that a report's path calls, within a budget of functions and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.resolution import pick_definitions

MOST_FUNCTIONS = 4
MOST_LINES = 100


def planned_callees(events: DataFrame, definitions: DataFrame, skipped: DataFrame | None = None, most_functions: int = MOST_FUNCTIONS, most_lines: int = MOST_LINES, total_lines: int | None = None) -> DataFrame:
    """report, place, callee, file, first_line, n_lines, cut: which bodies a report shows, in the order of their first calls.

    events: report, step, callee, file (the caller's, null if unknown); definitions: name, file, ordinal, first_line,
    last_line; skipped: report, callee. The first functions called count whether they have a definition or not, each once;
    of a body at most most_lines are taken, and bodies stop where the lines of all so far would pass total_lines. cut tells
    that a body has more lines than are shown. Null and empty callees are no calls."""
    named = events.where("callee IS NOT NULL AND trim(callee) <> ''").withColumn("callee", F.trim("callee"))
    if skipped is not None:
        named = named.join(skipped.select("report", "callee").distinct(), ["report", "callee"], "left_anti")
    once = named.groupBy("report", "callee").agg(F.min(F.struct("step", "file")).alias("first"))
    order = Window.partitionBy("report").orderBy("first.step", "callee")
    chosen = once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most_functions)
    asked = chosen.select(F.struct("report", "callee").alias("ask"), F.col("callee").alias("name"), F.col("first.file").alias("hint"))
    found = pick_definitions(asked, definitions).select("ask.report", "ask.callee", "file", "first_line", (F.col("last_line") - F.col("first_line") + 1).alias("_all"))
    shown = chosen.select("report", "callee", "place").join(found, ["report", "callee"]).withColumn("n_lines", F.least(F.col("_all"), F.lit(most_lines)))
    if total_lines is not None:
        running = F.sum("n_lines").over(Window.partitionBy("report").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
        shown = shown.withColumn("_sum", running).where(F.col("_sum") <= total_lines)
    return shown.select("report", "place", "callee", "file", "first_line", F.col("n_lines").cast("long").alias("n_lines"), (F.col("_all") > F.col("n_lines")).alias("cut"))


def callee_sources(planned: DataFrame, lines: DataFrame) -> DataFrame:
    """planned with body: the lines of each planned body, numbered within it. lines: file, line, text.

    A body that several reports show is put together once. Lines that the file doesn't have are left out; a body without
    any isn't shown."""
    spans = planned.select("file", "first_line", "n_lines").distinct()
    each = spans.withColumn("line", F.explode(F.expr("sequence(cast(first_line as bigint), first_line + n_lines - 1)")))
    held = each.join(lines.select("file", F.col("line").cast("long").alias("line"), "text"), ["file", "line"])
    told = F.concat((F.col("line") - F.col("first_line") + 1).cast("string"), F.lit(": "), F.coalesce("text", F.lit("")))
    body = held.groupBy("file", "first_line", "n_lines").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", told.alias("t")))), lambda x: x["t"]), "\n").alias("body"))
    return planned.join(body, ["file", "first_line", "n_lines"])
