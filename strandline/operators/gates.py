"""Gates and verdicts: what may be claimed about a report, and why; silence is never read as a claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import constraints as C
from strandline.functions import messages as M
from strandline.functions.constraints import is_pointer_parameter, requires_non_null


#: Names of checks that are always compiled and whose failing arm never returns; those that release builds leave out aren't among them.
FATAL_CHECKS = ("CHECK",)


def fabricated_entry_state(reports: DataFrame, steps: DataFrame, functions: DataFrame, checks: DataFrame, fatal: tuple[str, ...] = FATAL_CHECKS, key: str = "report_key") -> DataFrame:
    """Reports whose assumed entry state their own path refutes: key, function, parameter, check_line, check_step, deref_line.

    The path begins (after an error-start event at most) by assuming a null pointer; the null dereference at its end loads
    a variable that is a pointer parameter of the function around it; an always-compiled check that fails for null stands
    in that function before the dereference, and the path records its failing arm (direction true at its line) and walks
    on. Nothing may store to the variable before the check. Whatever can't be shown makes no claim.

    reports: key, bug_type; steps: key, step, kind, file, line, message, direction (null without one); functions: file, name,
    parameters, low, high (lines); checks: file, line, macro, condition. Null columns count as nothing known."""
    ordered = Window.partitionBy(key).orderBy("step")
    rows = steps.withColumn("_n", F.row_number().over(ordered))
    start = F.col("kind") == "error_start"
    begun = rows.groupBy(key).agg(F.min(F.when(~F.coalesce(start, F.lit(False)), F.struct("_n", "message"))).alias("_first"), F.max(F.struct("step", "file", "line", "message")).alias("_end"))
    begun = begun.where((F.col("_first._n") <= 2) & M.assumes_null_pointer(F.col("_first.message")))
    ends = begun.select(key, M.loaded(F.col("_end.message")).alias("parameter"), F.col("_end.file").alias("file"), F.col("_end.line").alias("deref_line")).where("parameter IS NOT NULL")
    asked = ends.join(reports.where(F.col("bug_type").rlike(r"(?i)null")).select(key).distinct(), key)
    around = asked.join(functions.select("file", F.col("name").alias("function"), "parameters", "low", "high"), "file").where("deref_line BETWEEN low AND high")
    around = around.where(is_pointer_parameter(F.col("parameters"), F.col("parameter")))
    held = around.join(checks.where(F.col("macro").isin(*fatal)).select("file", F.col("line").alias("check_line"), "condition"), "file")
    held = held.where("check_line BETWEEN low AND high AND check_line < deref_line").where(requires_non_null(F.col("condition"), F.col("parameter")))
    failing = rows.where("direction").select(key, "file", F.col("line").alias("check_line"), "step")
    taken = held.join(failing, [key, "file", "check_line"]).groupBy(key, "function", "parameter", "check_line", "deref_line").agg(F.min("step").alias("check_step"))
    stored = rows.select(key, F.col("step").alias("_s"), M.named_after(F.col("message"), "stored to ", "assigned to ").alias("parameter"))
    spoiled = taken.join(stored, [key, "parameter"]).where("_s < check_step").select(key, "parameter", "check_line").distinct()
    return taken.join(spoiled, [key, "parameter", "check_line"], "left_anti").select(key, "function", "parameter", "check_line", "check_step", "deref_line")


def no_path_verdict(reports: DataFrame, candidates: str, evidence: str) -> DataFrame:
    """Reports without any candidate path: an exhausted trace refutes it (FP), a bare location leaves it open (UNKNOWN); others have a null verdict."""
    none = F.col(candidates) == 0
    return reports.withColumn("verdict", F.when(none & (F.col(evidence) == "trace"), "FP").when(none, "UNKNOWN"))


def explored_verdict(attempts: DataFrame, key: str = "report_key") -> DataFrame:
    """Verdict over the attempts on a report: key, verdict, reason, n_attempts.

    attempts: key, verdict (TP, FP or UNKNOWN), leak (the verdict is that of the ownership layer), conforms (the attempt kept
    to the path asked for; null: it did), exhausted. A TP that isn't of the ownership layer decides. The ownership layer
    decides FP if at least two conforming attempts (all, if fewer) say so and none says TP; attempts that contradict one
    another there void it. Else FP takes attempts that are all FP in an exhausted space."""
    leak, conforms = F.coalesce("leak", F.lit(False)), F.coalesce("conforms", F.lit(True))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    per = attempts.groupBy(key).agg(
        F.count("*").alias("n_attempts"), count((F.col("verdict") == "TP") & ~leak).alias("_tp"), count((F.col("verdict") == "TP") & leak & conforms).alias("_for"),
        count((F.col("verdict") == "FP") & leak & conforms).alias("_against"), F.coalesce(F.bool_and(F.coalesce("verdict", F.lit("UNKNOWN")) == "FP"), F.lit(False)).alias("_fp"),
        F.coalesce(F.bool_or("exhausted"), F.lit(False)).alias("_done"),
    )
    agreed, void = (F.col("_for") == 0) & (F.col("_against") >= F.least(F.lit(2), "n_attempts")), (F.col("_for") > 0) & (F.col("_against") > 0)
    every = F.col("_done") & F.col("_fp")
    reason = F.when(F.col("_tp") > 0, "reachable").when(agreed, "leak consensus").when(every, "space exhausted").when(void, "leak contradiction").otherwise("undecided")
    verdict = F.when(F.col("_tp") > 0, "TP").when(agreed | every, "FP").otherwise("UNKNOWN")
    return per.select(key, verdict.alias("verdict"), reason.alias("reason"), "n_attempts")


def unsatisfiable(facts: DataFrame, key: str = "report_key") -> DataFrame:
    """Reports with a subject that equality facts give two values after normalization: key, subject, values, basis (ids of the facts).

    facts: key, fact_id, subject, operator, value."""
    value = F.regexp_replace(F.trim("value"), r"^\((.*)\)$", "$1")
    normal = F.when(value.isin("nullptr", "NULL", "null"), "0").when(value == "false", "0").when(value == "true", "1").otherwise(value)
    return (
        facts.where("operator = '=='").withColumn("_v", normal).groupBy(key, "subject")
        .agg(F.array_sort(F.collect_set("_v")).alias("values"), F.array_sort(F.collect_set("fact_id")).alias("basis")).where(F.size("values") > 1)
    )


def validated_solutions(solutions: DataFrame, facts: DataFrame, key: str = "report_key") -> DataFrame:
    """Claims of an outside solver, each with valid: it must cite two known facts at least, one stated by the report and one from the source.

    solutions: key, cited (array of fact ids); facts: key, fact_id, origin ('report_explicit', 'source_effect', 'source_literal')."""
    cited = solutions.withColumn("_s", F.monotonically_increasing_id())
    each = cited.select(key, "_s", F.explode(F.array_distinct("cited")).alias("fact_id")).join(facts.select(key, "fact_id", "origin"), [key, "fact_id"])
    per = each.groupBy("_s").agg(F.count("*").alias("_n"), F.bool_or(F.col("origin") == "report_explicit").alias("_r"), F.bool_or(F.col("origin").isin("source_effect", "source_literal")).alias("_e"))
    return cited.join(per, "_s", "left").withColumn("valid", F.coalesce((F.col("_n") >= 2) & F.col("_r") & F.col("_e"), F.lit(False))).drop("_s", "_n", "_r", "_e")


def falls_in_dead_range(rows: DataFrame, ranges: DataFrame, key: str, line: str = "line") -> DataFrame:
    """Adds dead: whether the line lies in a range (low, high) of its key. Ranges are merged first, so one look-back per row is enough."""
    spans = ranges.select(key, F.col("low").alias("_at"), F.col("high").alias("_high"), F.lit(0).alias("_q"))
    asks = rows.select(*rows.columns, F.col(line).alias("_at"), F.lit(None).cast("int").alias("_high"), F.lit(1).alias("_q"))
    both = asks.unionByName(spans, allowMissingColumns=True)
    reach = F.max("_high").over(Window.partitionBy(key).orderBy("_at", "_q").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return both.withColumn("dead", F.coalesce(reach >= F.col("_at"), F.lit(False))).where("_q = 1").select(*rows.columns, "dead")


def is_stuck(rounds: DataFrame, key: str = "report_key", most: int = 3) -> DataFrame:
    """Adds stuck: the round is the last allowed one, or repeats the signature of the one before without new hints."""
    w = Window.partitionBy(key).orderBy("round")
    same = F.coalesce(F.lag("signature").over(w) == F.col("signature"), F.lit(False))
    return rounds.withColumn("stuck", (F.col("round") >= most) | (same & ~F.coalesce(F.col("new_hints"), F.lit(False))))


def agreeing(condition: Column) -> Column:
    """Tri-state: null keeps; only a plain false drops."""
    return F.coalesce(condition, F.lit(True))


def hard_constraints(facts: DataFrame, key: str = "report_key") -> DataFrame:
    """What checked assumptions bind later ones to: key, variable, operator, value, each once.

    facts: key, variable, operator, value, result. A violated assumption binds to its opposite, a consistent equality to
    itself; anything else binds to nothing."""
    op = F.when(F.col("result") == "VIOLATED", C.negate(F.col("operator"))).when((F.col("result") == "CONSISTENT") & (F.col("operator") == "=="), F.lit("=="))
    return facts.select(key, "variable", op.alias("operator"), "value").where("operator IS NOT NULL").distinct()


def first_conflicts(facts: DataFrame, hard: DataFrame, key: str = "report_key") -> DataFrame:
    """The first assumption of each segment that a hard constraint on its variable rules out: key, segment, event, variable, operator, value, hard_operator, hard_value.

    facts: key, segment, event, variable, operator, value. Literal opposites clash whatever their values are; otherwise only
    numbers can. Segments without a clash have no row."""
    bound = hard.select(key, "variable", F.col("operator").alias("hard_operator"), F.col("value").alias("hard_value")).distinct()
    opposite = (C.negate(F.col("operator")) == F.col("hard_operator")) & C.same_text(F.col("value"), F.col("hard_value"))
    apart = C.intervals_clash(F.col("operator"), C.to_number(F.col("value")), F.col("hard_operator"), C.to_number(F.col("hard_value")))
    numbers = C.to_number(F.col("value")).isNotNull() & C.to_number(F.col("hard_value")).isNotNull()
    told = ["event", "variable", "operator", "value", "hard_operator", "hard_value"]
    clashes = facts.join(bound, [key, "variable"]).where(F.coalesce(opposite, F.lit(False)) | (numbers & apart))
    return clashes.groupBy(key, "segment").agg(F.min(F.struct(*told)).alias("_f")).select(key, "segment", "_f.*")
