"""Program-graph artifacts as tables: dependence graphs, call graphs, compile databases and line markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The artifact version that resolves; others are reported, not read.
ARTIFACT_VERSION = "1.3"

_NODE = (
    "struct<id: string, kind: string, variable: string, expression: string, type: string, source_line: int, source_col: int, block_id: int, "
    "is_call: boolean, callee: string, actual_params: array<string>, is_macro: boolean, macro_name: string, macro_def_file: string, macro_def_line: int>"
)
_FUNCTION = (
    f"struct<function_name: string, source_file: string, input_variables: array<string>, output_variables: array<string>, nodes: array<{_NODE}>, "
    "def_use_edges: array<struct<def_node_id: string, use_node_id: string, variable: string>>, "
    "control_dep_edges: array<struct<source_id: string, target_id: string, kind: string, is_macro_branch: boolean>>>"
)
PDG_SCHEMA = f"struct<metadata: struct<version: string, project: string>, functions: array<{_FUNCTION}>>"
CALLS_SCHEMA = (
    "struct<functions: array<struct<name: string, file: string, line: int>>, "
    "calls: array<struct<caller: string, callee: string, file: string, line: int, is_indirect: boolean>>>"
)
COMPILE_SCHEMA = "array<struct<directory: string, file: string, arguments: array<string>, command: string>>"


def whole_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: path, content."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))


def artifact_versions(documents: DataFrame) -> DataFrame:
    """path, version (null if there is none), usable."""
    version = F.get_json_object("content", "$.metadata.version")
    return documents.select("path", version.alias("version"), F.coalesce(version == ARTIFACT_VERSION, F.lit(False)).alias("usable"))


def read_pdg(documents: DataFrame) -> dict[str, DataFrame]:
    """functions, nodes, def_use and control_dep of dependence-graph documents; missing keys get the type's empty value.

    ordinal keeps the document's order, which settles every later tie."""
    parsed = documents.select("path", F.from_json("content", PDG_SCHEMA).alias("d"))
    each = parsed.select("path", F.posexplode("d.functions").alias("ordinal", "f")).withColumn("function_name", F.coalesce("f.function_name", F.lit("")))
    empty = F.array().cast("array<string>")
    functions = each.select(
        "path", "function_name", F.coalesce("f.source_file", F.lit("")).alias("source_file"),
        F.coalesce("f.input_variables", empty).alias("input_variables"), F.coalesce("f.output_variables", empty).alias("output_variables"), "ordinal",
    )
    n = each.select("path", "function_name", F.posexplode("f.nodes").alias("ordinal", "n"))
    text, number = F.lit(""), F.lit(0)
    nodes = n.select(
        "path", "function_name", F.coalesce("n.id", text).alias("id"), F.coalesce("n.kind", text).alias("kind"), F.coalesce("n.variable", text).alias("variable"),
        F.coalesce("n.expression", text).alias("expression"), F.coalesce("n.source_line", number).alias("source_line"), F.coalesce("n.source_col", number).alias("source_col"),
        F.coalesce("n.block_id", number).alias("block_id"), F.coalesce("n.is_call", F.lit(False)).alias("is_call"), F.coalesce("n.callee", text).alias("callee"),
        F.coalesce("n.actual_params", empty).alias("actual_params"), F.coalesce("n.is_macro", F.lit(False)).alias("is_macro"), F.col("n.macro_name").alias("macro_name"), "ordinal",
    )
    edges = each.select("path", "function_name", F.explode("f.def_use_edges").alias("e")).select("path", "function_name", "e.def_node_id", "e.use_node_id", F.coalesce("e.variable", text).alias("variable"))
    control = each.select("path", "function_name", F.explode("f.control_dep_edges").alias("e")).select(
        "path", "function_name", "e.source_id", "e.target_id", F.coalesce("e.kind", text).alias("kind"), F.coalesce("e.is_macro_branch", F.lit(False)).alias("is_macro_branch")
    )
    return {"functions": functions, "nodes": nodes, "def_use": edges, "control_dep": control}


def read_call_graph(documents: DataFrame) -> dict[str, DataFrame]:
    """functions and calls of call-graph documents."""
    parsed = documents.select("path", F.from_json("content", CALLS_SCHEMA).alias("d"))
    functions = parsed.select("path", F.posexplode("d.functions").alias("ordinal", "f")).select("path", "f.name", "f.file", "f.line", "ordinal")
    calls = parsed.select("path", F.posexplode("d.calls").alias("ordinal", "c")).select("path", "c.caller", "c.callee", "c.file", "c.line", F.coalesce("c.is_indirect", F.lit(False)).alias("is_indirect"), "ordinal")
    return {"functions": functions, "calls": calls}


def read_compile_database(documents: DataFrame) -> DataFrame:
    """path, directory, file, arguments of every entry; a command string is split at white space outside quotes."""
    parsed = documents.select("path", F.posexplode(F.from_json("content", COMPILE_SCHEMA)).alias("ordinal", "e"))
    words = F.transform(F.regexp_extract_all("e.command", F.lit(r'(?:[^\s"]++|"[^"]*+")++'), F.lit(0)), lambda w: F.replace(w, F.lit('"'), F.lit("")))
    return parsed.select("path", "ordinal", "e.directory", "e.file", F.coalesce("e.arguments", words).alias("arguments"))


def source_lines(documents: DataFrame) -> DataFrame:
    """path, line (from 1), text of every line of source documents."""
    lines = documents.select("path", F.posexplode(F.split("content", r"\r?\n", -1)).alias("_i", "text"))
    return lines.select("path", (F.col("_i") + 1).alias("line"), "text")


def origin_lines(lines: DataFrame) -> DataFrame:
    """Lines of preprocessed text with the origin that the marker before them gives: path, line, text, origin_file, origin_line; markers are dropped.

    A marker '# 12 "file.h"' says that the next line is line 12 of file.h."""
    marker = r'^#\s+(\d+)\s+"([^"]*)"'
    is_marker = F.col("text").rlike(marker)
    carried = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = F.last(F.when(is_marker, F.struct(F.col("line").alias("at"), F.regexp_extract("text", marker, 1).cast("int").alias("says"), F.regexp_extract("text", marker, 2).alias("file"))), ignorenulls=True).over(carried)
    return lines.withColumns({"_m": mark, "_is": is_marker}).where("NOT _is").select(
        "path", "line", "text", F.coalesce("_m.file", "path").alias("origin_file"), F.coalesce(F.col("_m.says") + F.col("line") - F.col("_m.at") - 1, F.col("line")).alias("origin_line")
    )


def augment_member_fields(nodes: DataFrame, is_definition: Column) -> DataFrame:
    """Extra def-use edges between definition and use sites of one member field of this: function_name, def_node_id, use_node_id, variable."""
    field = F.regexp_extract("expression", r"this->(\w+)", 1)
    sites = nodes.withColumns({"_f": field, "_d": is_definition}).where("_f <> ''")
    d = sites.where("_d").select("path", "function_name", F.col("id").alias("def_node_id"), "_f")
    u = sites.where("NOT _d").select("path", "function_name", F.col("id").alias("use_node_id"), "_f")
    return d.join(u, ["path", "function_name", "_f"]).select("path", "function_name", "def_node_id", "use_node_id", F.concat(F.lit("[this]."), "_f").alias("variable"))


def augment_unions(nodes: DataFrame, union_variables: DataFrame) -> DataFrame:
    """Extra def-use edges among nodes on lines that mention a union variable: every definition of it to every other node there.

    union_variables: (path, function_name, variable)."""
    lines = nodes.join(union_variables, ["path", "function_name", "variable"]).select("path", "function_name", "variable", "source_line").distinct()
    defs = nodes.join(union_variables, ["path", "function_name", "variable"]).select("path", "function_name", "variable", F.col("id").alias("def_node_id"))
    others = nodes.drop("variable").join(lines, ["path", "function_name", "source_line"]).select("path", "function_name", "variable", F.col("id").alias("use_node_id")).distinct()
    return defs.join(others, ["path", "function_name", "variable"]).where("def_node_id <> use_node_id").select("path", "function_name", "def_node_id", "use_node_id", "variable")


def slice_mask(nodes: DataFrame, slice_nodes: DataFrame, control: DataFrame) -> DataFrame:
    """Per node whether a slice retains it, and per predicate whether it is a retained branch: path, function_name, id, retained, is_branch."""
    kept = slice_nodes.select("path", "function_name", "id").distinct().withColumn("_k", F.lit(True))
    branches = control.select("path", "function_name", F.col("source_id").alias("id")).distinct().withColumn("_b", F.lit(True))
    keys = ["path", "function_name", "id"]
    return nodes.select(*keys).join(kept, keys, "left").join(branches, keys, "left").select(*keys, F.coalesce("_k", F.lit(False)).alias("retained"), F.coalesce("_b", F.lit(False)).alias("is_branch"))
