"""Branch decisions: what a constraint says about them, which paths are shortest, what a path contradicts, and what matters to a cause."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import constraints as C
from strandline.functions import text as X
from strandline.operators.enumeration import keep_all_if_empty, top_candidates
from strandline.operators.traces import MOST_PATHS, assumptions, enumerate_paths, evaluated


def branch_verdict(condition: Column, taken: Column, constraint: Column) -> Column:
    """consistent, contradictory or insufficient_info of a branch under a constraint on the same variable.

    A branch not taken requires the opposite of its condition. Variables are the same if their last components are; a
    variable alone means that it isn't null, with ! in front that it is."""
    last = lambda v: F.element_at(F.split(v, r"->|\."), -1)
    plain = F.regexp_extract(condition, r"^\s*(!?)\s*([A-Za-z_][\w.]*(?:->\w+)*+)\s*$", 2)
    bang = F.regexp_extract(condition, r"^\s*(!?)\s*([A-Za-z_][\w.]*(?:->\w+)*+)\s*$", 1)
    alone = F.struct(plain.alias("variable"), F.when(bang == "!", "==").otherwise("!=").alias("operator"), F.lit("0").alias("value"))
    need, given = F.when(plain != "", alone).otherwise(C.parse_constraint(condition)), C.parse_constraint(constraint)
    op = F.when(taken, need["operator"]).otherwise(C.negate(need["operator"]))
    a, b = C.to_number(given["value"]), C.to_number(need["value"])
    known = (last(need["variable"]) == last(given["variable"])) & a.isNotNull() & b.isNotNull()
    meets = C.ranges_intersect(given["operator"], a, op, b)
    return F.when(F.coalesce(known, F.lit(False)), F.when(meets, "consistent").otherwise("contradictory")).otherwise("insufficient_info")


def shortest_paths(branches: DataFrame, segment: str, k: int, groups: DataFrame | None = None, wanted: DataFrame | None = None, most: int = MOST_PATHS) -> DataFrame:
    """The k paths of each segment that are least by (S, C, V), then by the order of the walk: segment, path, decisions, S, C, V, rank.

    wanted (node, taken): paths that decide such a node otherwise are dropped; groups (nodes array): paths that take two
    nodes of a group are. A filter that leaves a segment nothing is not applied to it."""
    paths = enumerate_paths(branches, segment, most)
    each = paths.select(segment, "path", F.explode("decisions").alias("d")).select(segment, "path", "d.node", "d.taken")
    keys = [segment, "path"]
    if wanted is not None:
        against = each.join(wanted.select("node", F.col("taken").alias("_w")), "node").where("taken <> _w").select(*keys).distinct().withColumn("_against", F.lit(True))
        paths = keep_all_if_empty(paths.join(against, keys, "left"), segment, F.col("_against").isNull()).drop("_against")
    if groups is not None:
        member = groups.select(F.array_join("nodes", "\n").alias("_g"), F.explode("nodes").alias("node")).distinct()
        twice = each.where("taken").join(member, "node").groupBy(*keys, "_g").agg(F.count("*").alias("_n")).where("_n >= 2").select(*keys).distinct().withColumn("_twice", F.lit(True))
        paths = keep_all_if_empty(paths.join(twice, keys, "left"), segment, F.col("_twice").isNull()).drop("_twice")
    return top_candidates(paths, segment, ["S", "C", "V"], ["path"], k)


def direction_conflicts(events: DataFrame, macros: dict[str, str], key: str = "report_key") -> DataFrame:
    """Control events whose condition, evaluated under the report's own values and source macros, goes the other way: key, step, condition, claimed, evaluated.

    events: key, step, message, condition, direction. Values are what the report assumes about names and what calls return,
    over all of the report's events, the last one winning. A condition with an unknown name makes no claim."""
    said = lambda start: F.regexp_extract("message", rf"^\W*{start}\s+'?([^\s']+)", 1)
    call = F.nullif(said("Calling"), F.lit(""))
    w = Window.partitionBy(key).orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = assumptions(events.withColumns({"line": F.lit(None).cast("int"), "_call": F.last(call, ignorenulls=True).over(w)}), keep_others=True)
    equal = (F.col("operator") == "==") & F.lower("message").contains("assuming") & ~F.col("variable").startswith("condition@")
    back = F.nullif(said("Returning the value"), F.lit(""))
    name = F.when(equal, F.col("variable")).when(back.isNotNull(), F.col("_call"))
    value = F.when(equal, F.col("value")).otherwise(back)
    facts = named.select(key, "step", name.alias("n"), value.alias("v")).where("n IS NOT NULL AND v IS NOT NULL").groupBy(key, "n").agg(F.max(F.struct("step", "v"))["v"].alias("v"))
    known = facts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("n", "v"))).alias("_facts"))
    fixed = F.create_map(*[F.lit(x) for kv in macros.items() for x in kv]) if macros else F.create_map().cast("map<string,string>")
    asked = events.where("direction IS NOT NULL AND condition <> ''").join(known, key)
    both = F.map_concat(F.map_filter(fixed, lambda k, _: ~F.map_contains_key(F.col("_facts"), k)), F.col("_facts"))
    judged = asked.withColumn("evaluated", evaluated(F.col("condition"), both))
    return judged.where("evaluated <> direction").select(key, "step", "condition", F.col("direction").alias("claimed"), "evaluated")


def relevance(decisions: DataFrame, retained: DataFrame) -> DataFrame:
    """node, relevant of every decision: a graph node is relevant if a slice retains it; a node that the graph doesn't know is relevant.

    decisions: node; retained: node, retained."""
    nodes = decisions.select("node").distinct()
    return nodes.join(retained.groupBy("node").agg(F.bool_or("retained").alias("_r")), "node", "left").select("node", F.coalesce("_r", F.lit(True)).alias("relevant"))


def relevance_summary(classified: DataFrame) -> DataFrame:
    """n_relevant, n_irrelevant and the irrelevant share to three places, in one row."""
    n = F.count("*")
    r = F.coalesce(F.sum(F.when(F.col("relevant"), 1).otherwise(0)), F.lit(0))
    return classified.agg(r.alias("n_relevant"), (n - r).alias("n_irrelevant"), F.coalesce(F.round((n - r) / F.nullif(n, F.lit(0)), 3), F.lit(0.0)).alias("ratio"))


def prune_anchored(nodes: DataFrame, control: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Nodes that stay once contradictory predicates and what they directly control are gone: id.

    nodes: id; control: source_id, target_id; verdicts: id, verdict."""
    gone = verdicts.where("verdict = 'contradictory'").select("id").distinct()
    below = control.join(gone.withColumnRenamed("id", "source_id"), "source_id").select(F.col("target_id").alias("id"))
    return nodes.select("id").join(gone.unionByName(below).distinct(), "id", "left_anti")


def alignment(blocks: DataFrame, nodes: DataFrame, least: int = 4) -> DataFrame:
    """How far two block numberings of a function agree: function_name, ratio, n_compared, trusted (5 blocks at least, 0.7 of them agreeing).

    blocks: function_name, block, statements (array); nodes: function_name, block, expression. A block agrees if one of its
    statements lies in an expression recorded for that block; blocks without comparable text on both sides don't count."""
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    s = blocks.select("function_name", "block", F.filter(F.transform("statements", bare), lambda x: F.length(x) >= least).alias("_s")).where(F.size("_s") > 0)
    e = nodes.select("function_name", "block", bare(F.col("expression")).alias("_e")).where(F.length("_e") >= least).groupBy("function_name", "block").agg(F.collect_set("_e").alias("_e"))
    agrees = F.exists("_s", lambda x: F.exists("_e", lambda y: y.contains(x)))
    per = s.join(e, ["function_name", "block"]).groupBy("function_name").agg(F.avg(agrees.cast("double")).alias("ratio"), F.count("*").alias("n_compared"))
    return per.withColumn("trusted", (F.col("n_compared") >= 5) & (F.col("ratio") >= 0.7))


def references(steps: DataFrame, key: str = "report_key") -> DataFrame:
    """Places a report points at, each once, in the report's order, with the role of its first step: key, position, file, line, role."""
    first = steps.where("file <> '' AND line > 0").groupBy(key, "file", "line").agg(F.min(F.struct("step", "kind")).alias("_f"))
    return first.select(key, F.row_number().over(Window.partitionBy(key).orderBy("_f.step")).alias("position"), "file", "line", F.col("_f.kind").alias("role"))


def mine_setters(lines: DataFrame) -> DataFrame:
    """Constructor-like initializers and guarded flag assignments in source lines: file, line, kind, subject, value.

    kind 'initial' for name(value) in an initializer list or 'name = literal;', 'guard' for a field named in a condition that
    compares it with a literal."""
    code = X.strip_comment(F.col("text"))
    literal = r"(-?\d+[uUlL]*|true|false|nullptr|NULL|[A-Z][A-Z0-9_]{2,})"
    forms = [("initial", rf"^\s*[:,]\s*(\w+)[({{]{literal}[)}}]"), ("initial", rf"^\s*(?:this->)?([A-Za-z_]\w*)\s*=\s*{literal}\s*;"), ("guard", rf"\bif\s*\(\s*!?\s*(?:this->)?([A-Za-z_][\w.]*(?:->\w+)*)\s*[=!]=\s*{literal}\s*\)")]
    found = F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract(code, p, 1).alias("subject"), F.regexp_extract(code, p, 2).alias("value")) for k, p in forms]), lambda f: f["subject"] != "")
    return lines.select("file", "line", F.explode(found).alias("f")).select("file", "line", "f.kind", "f.subject", "f.value")


def opaque_writes(nodes: DataFrame, writers: tuple[str, ...] = ("memcpy", "memset", "memmove", "read", "fread", "recv", "copy")) -> DataFrame:
    """Extra def-use edges from a call that writes through the address of a variable to all nodes that mention its members: function_name, def_node_id, use_node_id, variable."""
    target = F.regexp_extract("expression", r"&\s*([A-Za-z_]\w*)", 1)
    calls = nodes.where(X.short_name(F.col("callee")).isin(*writers)).select("function_name", F.col("id").alias("def_node_id"), target.alias("variable")).where("variable <> ''")
    mentions = nodes.select("function_name", F.col("id").alias("use_node_id"), F.explode(F.array_distinct(F.regexp_extract_all("expression", F.lit(r"([A-Za-z_]\w*)\."), F.lit(1)))).alias("variable"))
    return calls.join(mentions, ["function_name", "variable"]).where("def_node_id <> use_node_id").select("function_name", "def_node_id", "use_node_id", "variable")


def required_returns(decisions: DataFrame, key: str = "path") -> DataFrame:
    """What a caller's branch asks of a call on its line: key, function, line, callee, required (null if the branch leaves it open).

    The first decided branch that calls the name counts. Taken, it asks for true (false behind a !) unless alternatives are
    joined by ||; not taken, for the opposite unless && joins it to others."""
    calls = F.regexp_extract_all("condition", F.lit(r"(!?)\s*(?<![\w:])([A-Za-z_][\w:]*)\s*\("), F.lit(0))
    branches = decisions.where("kind <> 'call' AND taken IS NOT NULL").select(key, "position", "function", "line", "condition", "taken", F.explode(F.array_distinct(calls)).alias("_call"))
    negated = F.col("_call").startswith("!")
    asks = F.when(F.col("taken"), F.when(~F.col("condition").contains("||"), ~negated)).otherwise(F.when(~F.col("condition").contains("&&"), negated))
    name = F.regexp_extract("_call", r"([A-Za-z_][\w:]*)\s*\($", 1)
    place = F.struct("position", F.instr("condition", F.col("_call")).alias("at"), asks.alias("required"))
    return branches.groupBy(key, "function", "line", name.alias("callee")).agg(F.min(place)["required"].alias("required"))


def selected_returns(decisions: DataFrame, returns: DataFrame, key: str = "path") -> DataFrame:
    """The truth value that a path's decisions inside a function make it return: key, callee (short name), selected, return_line, file.

    returns: file, function, owner, line, returned, as structure.truth_returns gives them. The first taken branch that
    returns by itself counts, else the function's own return; of several files the one the path meets first."""
    short = X.short_name(F.col("function"))
    inside = decisions.where("kind = 'control' AND file <> ''").select(key, "position", "file", "line", "taken", short.alias("callee"))
    known = returns.select("file", short.alias("callee"), "owner", "line", F.struct("line", "returned").alias("_r"))
    own = known.where("owner = 'function'").groupBy("file", "callee").agg(F.max("_r").alias("_own"))
    early = known.where("owner = 'branch'").groupBy("file", "callee", "line").agg(F.min("_r").alias("_r"))
    per = inside.join(early, ["file", "callee", "line"], "left").groupBy(key, "callee", "file").agg(F.min("position").alias("_at"), F.min(F.when(F.col("taken"), F.col("_r"))).alias("_early"))
    chosen = per.join(own, ["file", "callee"], "left").withColumn("_c", F.coalesce("_early", "_own")).where("_c IS NOT NULL")
    best = chosen.groupBy(key, "callee").agg(F.min(F.struct("_at", "file", "_c")).alias("_b"))
    return best.select(key, "callee", F.col("_b._c.returned").alias("selected"), F.col("_b._c.line").alias("return_line"), F.col("_b.file").alias("file"))


def call_return_violations(decisions: DataFrame, returns: DataFrame, key: str = "path") -> DataFrame:
    """Calls whose result a branch needs otherwise than the callee's own decisions make it: key, caller, call_line, callee, required, selected, return_line, file.

    decisions: key, position, kind (call, control or other), function, file, line, condition, taken, callee. A value that
    isn't known on either side contradicts nothing; a site is named once."""
    sites = decisions.where("kind = 'call' AND callee <> ''").select(key, "function", "line", "callee").distinct()
    asked = sites.join(required_returns(decisions, key).where("required IS NOT NULL"), [key, "function", "line", "callee"])
    against = asked.join(selected_returns(decisions, returns, key), [key, "callee"]).where("required <> selected")
    return against.select(key, F.col("function").alias("caller"), F.col("line").alias("call_line"), "callee", "required", "selected", "return_line", "file")
