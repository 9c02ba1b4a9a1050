"""SARIF 2.1.0 documents as findings and steps.

Documents are read as whole texts and parsed with an explicit schema, so only the parts that are used are decoded and a
missing part is null. One document is one row until its results are exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_REGION = "region: struct<startLine: int, startColumn: int, endLine: int, endColumn: int>"
_PHYSICAL = f"physicalLocation: struct<artifactLocation: struct<uri: string, uriBaseId: string>, {_REGION}>"
_LOCATION = f"struct<{_PHYSICAL}, message: struct<text: string>>"
_RULE = "struct<id: string, name: string, shortDescription: struct<text: string>, defaultConfiguration: struct<level: string>, properties: map<string, string>>"
_RESULT = (
    f"struct<ruleId: string, ruleIndex: int, level: string, message: struct<text: string>, locations: array<{_LOCATION}>, "
    f"partialFingerprints: map<string, string>, suppressions: array<struct<kind: string>>, "
    f"codeFlows: array<struct<threadFlows: array<struct<locations: array<struct<location: {_LOCATION}>>>>>>>"
)
SCHEMA = f"struct<version: string, runs: array<struct<tool: struct<driver: struct<name: string, version: string, rules: array<{_RULE}>>>, results: array<{_RESULT}>>>>"

#: Tool names by analyzer.
ANALYZERS = {"codeql": "codeql", "infer": "infer", "clang": "csa", "semgrep": "semgrep"}


def analyzer_of(driver: Column) -> Column:
    """The analyzer that a driver's name stands for, 'unknown' if none."""
    out = None
    for word, name in ANALYZERS.items():
        test = F.lower(driver).contains(word)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("unknown")


def severity_of(properties: Column, level: Column) -> Column:
    """error, warning, note or unknown: from problem.severity, else security-severity (7 and 4 bound the grades), else the level."""
    named = F.lower(F.try_element_at(properties, F.lit("problem.severity")))
    score = F.try_element_at(properties, F.lit("security-severity")).try_cast("double")
    graded = F.when(score >= 7, "error").when(score >= 4, "warning").when(score.isNotNull(), "note")
    plain = F.when(level.isin("error", "warning", "note"), level).when(level == "none", "note")
    return F.coalesce(F.when(named.isin("error", "warning"), named).when(named.isin("recommendation", "note"), "note"), graded, plain, F.lit("unknown"))


def path_of(uri: Column) -> Column:
    """A URI as a path: scheme and a base placeholder dropped, percent signs decoded."""
    bare = F.regexp_replace(F.regexp_replace(uri, r"^file://(localhost)?", ""), r"^%SRCROOT%/?", "")
    return F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B")))


def read_sarif(spark: SparkSession, path: str) -> DataFrame:
    """path (a file, folder or glob) as one row per document: path, content, doc (null where it is no JSON)."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))
    return raw.withColumn("doc", F.from_json("content", SCHEMA))


def _place(location: Column) -> Column:
    physical = location["physicalLocation"]
    region = physical["region"]
    return F.struct(path_of(physical["artifactLocation"]["uri"]).alias("file"), F.coalesce(region["startLine"], F.lit(0)).alias("line"), F.coalesce(region["startColumn"], F.lit(0)).alias("column"))


def findings(documents: DataFrame) -> DataFrame:
    """One row per result: path, run, result, finding_id, analyzer, rule_id, severity, message, file, line, column, fingerprint, suppressed, path_evidence, flow.

    Ids that repeat in a document get #2, #3 and so on. flow holds the locations of the code flow with most of them (the
    first of equals), its thread flows joined in order; path_evidence is 'trace' if it has more than one, else 'location'."""
    runs = documents.select("path", F.posexplode("doc.runs").alias("run", "r"))
    rows = runs.select("path", "run", F.col("r.tool.driver").alias("driver"), F.posexplode("r.results").alias("result", "x"))
    rule_id = F.coalesce("x.ruleId", F.get(F.col("driver.rules"), F.col("x.ruleIndex"))["id"], F.lit("unknown"))
    rule = F.get(F.filter("driver.rules", lambda r: r["id"] == F.col("rule_id")), F.lit(0))
    flat = F.transform(F.coalesce("x.codeFlows", F.array()), lambda f: F.flatten(F.transform(f["threadFlows"], lambda t: F.coalesce(t["locations"], F.array()))))
    sized = F.transform(flat, lambda f, i: F.struct(F.size(f).alias("n"), (-i).alias("first"), f.alias("flow")))
    longest = F.aggregate(sized, F.get(sized, F.lit(0)), lambda a, b: F.when(b["n"] > a["n"], b).otherwise(a))["flow"]
    found = rows.withColumn("rule_id", rule_id).withColumns({"rule": rule, "flow": longest, "at": _place(F.get(F.col("x.locations"), F.lit(0)))})
    base = F.concat_ws(":", "rule_id", "at.file", "at.line")
    nth = F.row_number().over(Window.partitionBy("path", base).orderBy("run", "result"))
    return found.select(
        "path", "run", "result",
        F.when(nth == 1, base).otherwise(F.concat(base, F.lit("#"), nth)).alias("finding_id"),
        analyzer_of(F.col("driver.name")).alias("analyzer"), "rule_id",
        severity_of(F.col("rule.properties"), F.coalesce("x.level", "rule.defaultConfiguration.level")).alias("severity"),
        F.col("x.message.text").alias("message"), "at.file", "at.line", "at.column",
        F.get(F.map_values(F.col("x.partialFingerprints")), F.lit(0)).alias("fingerprint"),
        (F.size(F.coalesce("x.suppressions", F.array())) > 0).alias("suppressed"),
        F.when(F.size("flow") > 1, "trace").otherwise("location").alias("path_evidence"), "flow",
    )


def steps(found: DataFrame) -> DataFrame:
    """Ordered steps of each finding: finding_id, path, step (from 1), kind, file, line, message.

    A message with [Return] is a return. The last step is a report: the flow's last location if it is the finding's own
    place, else one is added for it."""
    moved = F.transform(
        F.coalesce("flow", F.array()),
        lambda f: F.struct(
            _place(f["location"]).alias("at"), F.coalesce(f["location"]["message"]["text"], F.lit("")).alias("message"),
        ),
    )
    own = F.struct(F.struct(F.col("file").alias("file"), F.col("line").alias("line"), F.col("column").alias("column")).alias("at"), F.coalesce("message", F.lit("")).alias("message"))
    rows = found.withColumn("_moved", moved)
    last = F.get(F.col("_moved"), F.size("_moved") - 1)["at"]
    ends = F.coalesce((last["file"] == F.col("file")) & (last["line"] == F.col("line")), F.lit(False))
    rows = rows.withColumn("_steps", F.when(ends, F.col("_moved")).otherwise(F.concat("_moved", F.array(own))))
    each = rows.select("finding_id", "path", F.size("_steps").alias("_n"), F.posexplode("_steps").alias("_i", "s"))
    kind = F.when(F.col("_i") == F.col("_n") - 1, "report").when(F.col("s.message").contains("[Return]"), "return").otherwise("event")
    return each.select("finding_id", "path", (F.col("_i") + 1).alias("step"), kind.alias("kind"), F.col("s.at.file").alias("file"), F.col("s.at.line").alias("line"), F.col("s.message").alias("message"))


def select_finding(found: DataFrame, selector: str) -> DataFrame:
    """The finding that a selector names: by id, else fingerprint, else file:line or rule@file:line or line, else a rule with one finding."""
    s, place = F.lit(selector), F.concat_ws(":", "file", "line")
    only = F.count("*").over(Window.partitionBy("path", "rule_id")) == 1
    rank = (
        F.when(F.col("finding_id") == s, 1).when(F.col("fingerprint") == s, 2)
        .when((place == s) | F.concat_ws("@", F.col("rule_id"), place).eqNullSafe(s) | (F.col("line").cast("string") == s), 3)
        .when((F.col("rule_id") == s) & only, 4)
    )
    ranked = found.withColumn("_rank", rank).where("_rank IS NOT NULL")
    return ranked.withColumn("_best", F.min("_rank").over(Window.partitionBy("path"))).where("_rank = _best").drop("_rank", "_best")
