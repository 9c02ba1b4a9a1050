"""State of each source file as attempts to parse it come in, and the graph of a report put together from what is parsed.

Attempts are a stream. Each file has a small state: what its last attempt gave and how often it failed since it last
succeeded. A stream that starts again from its checkpoint goes on with that state; attempts it saw before change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandline.operators.resolution import resolve_functions
from strandline.operators.traces import base_name

#: Files of a report whose graphs are put together.
MOST_FILES = 32
#: Attempts without success after which a file counts as failed; before that it is to be tried again.
MOST_ATTEMPTS = 2
#: Outcomes of an attempt that leave a graph, whole or in part.
USABLE = ("parsed", "partial")


def next_status(state: tuple[int, int, str | None, str | None], attempt: int, outcome: str, message: str | None, most_attempts: int = MOST_ATTEMPTS) -> tuple[int, int, str | None, str | None]:
    """(last attempt, failures since a success, status, message) after one more attempt; one that isn't later changes nothing."""
    last, failures, _, _ = state
    if attempt <= last:
        return state
    if outcome in USABLE:
        return attempt, 0, outcome, message
    failures += 1
    return attempt, failures, "failed" if failures >= most_attempts else "retry", message or outcome


def file_status(attempts: DataFrame, most_attempts: int = MOST_ATTEMPTS) -> DataFrame:
    """A stream of file, status, attempt, failures, message: the state of each file that new attempts changed.

    attempts, a stream: file, attempt (a rising number), outcome (parsed, partial; anything else is a failure), message.
    Status: parsed, partial, retry (failed, to be tried again), failed (as often as most_attempts). A failed file keeps its
    row and its error until a later attempt replaces it. Attempts of one batch count in the order of their numbers; rows
    without a file or a number are left out."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = tuple(held.get) if held.exists else (-1, 0, None, None)
        before = state
        for attempt, outcome, message in sorted((tuple(r) for b in batches for r in b[["attempt", "outcome", "message"]].values.tolist()), key=lambda r: r[0]):
            state = next_status(state, int(attempt), outcome, message, most_attempts)
        held.update(state)
        if state != before:
            yield pd.DataFrame([(key[0], state[2], state[0], state[1], state[3])], columns=["file", "status", "attempt", "failures", "message"])

    known = attempts.where("file IS NOT NULL AND attempt IS NOT NULL").select("file", F.col("attempt").cast("long").alias("attempt"), "outcome", "message")
    return known.groupBy("file").applyInPandasWithState(step, "file string, status string, attempt long, failures int, message string", "attempt long, failures int, status string, message string", "update", GroupStateTimeout.NoTimeout)


def latest_status(updates: DataFrame) -> DataFrame:
    """file, status, attempt, failures, message: the last state of each file among the rows that file_status gave."""
    return updates.groupBy("file").agg(F.max_by(F.struct("status", "attempt", "failures", "message"), "attempt").alias("s")).select("file", "s.*")


def report_files(references: DataFrame, most_files: int = MOST_FILES) -> DataFrame:
    """report, file, place: the first so many distinct files that a report points at. references: report, ordinal, file (null
    where it couldn't be resolved)."""
    once = references.where("file IS NOT NULL").groupBy("report", "file").agg(F.min("ordinal").alias("ordinal"))
    place = F.row_number().over(Window.partitionBy("report").orderBy("ordinal", "file"))
    return once.withColumn("place", place).where(F.col("place") <= most_files).select("report", "file", "place")


def report_graph(files: DataFrame, statuses: DataFrame, functions: DataFrame) -> DataFrame:
    """report, id, name, file, first_line, last_line: the functions of a report's usable files.

    files: report_files; statuses: file, status; functions: file, name, first_line, last_line. The first function of a name,
    by the place of its file and its line, has the name as id, later ones the name with `#L` and their line."""
    usable = statuses.where(F.col("status").isin(*USABLE)).select("file")
    held = files.join(usable, "file").join(functions, "file")
    place = F.row_number().over(Window.partitionBy("report", "name").orderBy("place", "first_line", "last_line"))
    id_ = F.when(place == 1, F.col("name")).otherwise(F.concat("name", F.lit("#L"), F.col("first_line").cast("string")))
    return held.select("report", id_.alias("id"), "name", "file", "first_line", "last_line")


def report_calls(files: DataFrame, graph: DataFrame, calls: DataFrame) -> DataFrame:
    """report, file, line, callee, target, confidence: the calls of a report's files, resolved by names over all its files.

    calls: file, line, callee. One function of the name: syntactic; several: candidate, without a target; none: unresolved."""
    names = graph.groupBy("report", F.element_at(F.split("name", "::"), -1).alias("short")).agg(F.count("*").alias("n"), F.min("id").alias("only"))
    made = files.join(graph.select("report", "file").distinct(), ["report", "file"]).join(calls, "file").withColumn("short", F.element_at(F.split("callee", "::"), -1))
    told = made.join(names, ["report", "short"], "left")
    confidence = F.when(F.col("n") == 1, "syntactic").when(F.col("n") > 1, "candidate").otherwise("unresolved")
    return told.select("report", "file", "line", "callee", F.when(F.col("n") == 1, F.col("only")).alias("target"), confidence.alias("confidence"))


def graph_summary(references: DataFrame, files: DataFrame, statuses: DataFrame, graph: DataFrame) -> DataFrame:
    """report, files, usable, failed, unresolved, functions: how much of a report its graph covers; files without any status
    count as neither usable nor failed."""
    asked = references.groupBy("report").agg(F.sum(F.when(F.col("file").isNull(), 1).otherwise(0)).alias("unresolved"))
    good = F.col("status").isin(*USABLE)
    per = files.join(statuses.select("file", "status"), "file", "left").groupBy("report").agg(F.count("*").alias("files"), F.count(F.when(good, 1)).alias("usable"), F.count(F.when(F.col("status") == "failed", 1)).alias("failed"))
    found = graph.groupBy("report").agg(F.count("*").alias("functions"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return asked.join(per, "report", "left").join(found, "report", "left").select("report", none("files"), none("usable"), none("failed"), "unresolved", none("functions"))


def covered_reports(reports: DataFrame, graph: DataFrame, lines: DataFrame) -> DataFrame:
    """report, covered: whether a report's graph has its function, or a function in a file of its name with a node on its line.

    reports: report, function, file, line (0 or null: any line does); graph: report_graph; lines: file, line of all nodes."""
    ask = F.struct(F.col("report").alias("report"), F.col("function").alias("wanted"))
    scope = lambda c: F.concat(F.col("report").cast("string"), F.lit("\u0001"), c)
    # names are looked up within the report: its key stands before each, so nothing of another report can match
    named = resolve_functions(
        reports.where("function <> ''").select(ask.alias("ask"), scope(F.col("function")).alias("name")),
        graph.select(scope(F.col("name")).alias("name"), F.col("first_line").alias("ordinal")).unionByName(graph.select(scope(F.element_at(F.split("name", "::"), -1)).alias("name"), F.col("first_line").alias("ordinal"))),
    ).where("strategy = 'exact'").select("ask.report").distinct()
    there = graph.select("report", "file", base_name(F.col("file")).alias("base")).distinct()
    wanted = reports.where("file <> ''").select("report", base_name(F.col("file")).alias("base"), F.coalesce("line", F.lit(0)).alias("line"))
    met = wanted.join(there, ["report", "base"])
    placed = met.where("line = 0").select("report").unionByName(met.where("line <> 0").join(lines.select("file", "line").distinct(), ["file", "line"], "left_semi").select("report"))
    yes = named.unionByName(placed).distinct().withColumn("covered", F.lit(True))
    return reports.select("report").distinct().join(yes, "report", "left").select("report", F.coalesce("covered", F.lit(False)).alias("covered"))
