"""Traces against graphs and sources: matching, annotations, assumptions, windows, slices across functions and path enumeration."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from strandline.functions import messages as M
from strandline.functions.c_expression import truth
from strandline.operators.graph import fixpoint, settle
from strandline.operators.joins import band_join

#: Lines that a graph node may lie off an event's.
LINE_BAND = 5
#: Paths enumerated per segment.
MOST_PATHS = 200
#: Root branches of a segment beyond which paths are picked greedily.
GREEDY_ROOTS = 15


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_rank(known: Column, reported: Column) -> Column:
    """How two paths match: 0 equal, 1 one ends in the other, 2 last two components, 3 base name; null if not at all."""
    tail = lambda p: F.array_join(F.slice(F.split(p, "/"), -2, 2), "/")
    both = F.size(F.split(known, "/")) >= 2
    return (
        F.when(known == reported, 0).when(F.endswith(known, F.concat(F.lit("/"), reported)) | F.endswith(reported, F.concat(F.lit("/"), known)), 1)
        .when(both & (F.size(F.split(reported, "/")) >= 2) & (tail(known) == tail(reported)), 2).when(base_name(known) == base_name(reported), 3)
    )


def match_events(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """Graph nodes of each event: those on its line in a matching file, or if there are none those within the band: event, node, distance.

    events: event, file, line (0: unknown, matches nothing); nodes: node, source_file, source_line."""
    left = events.where("line > 0").select("event", "file", "line", base_name(F.col("file")).alias("_base"))
    right = nodes.where("source_line > 0").select("node", "source_file", "source_line", base_name(F.col("source_file")).alias("_base"))
    near = band_join(left, right, "line", "source_line", LINE_BAND, ["_base"]).where(file_rank(F.col("source_file"), F.col("file")).isNotNull())
    near = near.withColumn("distance", F.abs(F.col("line") - F.col("source_line")))
    exact = F.min("distance").over(Window.partitionBy("event")) == 0
    return near.withColumn("_exact", exact).where("distance = 0 OR NOT _exact").select("event", "node", "distance")


def path_annotations(events: DataFrame, predicates: DataFrame) -> DataFrame:
    """function_name, line -> taken for control predicates that a path's control events stand on; the last event of a line wins, the first function by name.

    events: step, file, line, direction; predicates: function_name, source_file, source_line. Events without a direction say nothing."""
    said = events.where("direction IS NOT NULL").groupBy("file", "line").agg(F.max(F.struct("step", "direction"))["direction"].alias("taken"))
    known = predicates.groupBy("source_file", "source_line").agg(F.min("function_name").alias("function_name")).withColumn("_base", base_name(F.col("source_file")))
    joined = said.withColumn("_base", base_name(F.col("file"))).join(known, ["_base"]).where((F.col("line") == F.col("source_line")) & file_rank(F.col("source_file"), F.col("file")).isNotNull())
    return joined.select("function_name", "line", "taken")


def assumptions(events: DataFrame, text: str = "message", line: str = "line", keep_others: bool = False) -> DataFrame:
    """Adds variable, operator, value of what an event assumes or stores; events that do neither are left out, or kept with
    nulls. An assumption about the condition itself is named after its line."""
    given, put = M.assumed(F.col(text)), M.stored(F.col(text))
    said = F.when(given.isNotNull(), given).when(put.isNotNull(), F.struct(put["subject"].alias("subject"), F.lit("==").alias("operator"), put["value"].alias("value")))
    found = events.withColumn("_f", said)
    name = F.when(F.col("_f.subject") == "condition", F.concat(F.lit("condition@L"), F.col(line).cast("string"))).otherwise(F.col("_f.subject"))
    return (found if keep_others else found.where("_f IS NOT NULL")).select(*events.columns, name.alias("variable"), F.col("_f.operator").alias("operator"), F.col("_f.value").alias("value"))


def line_alignment(probes: DataFrame, lines: DataFrame, key: str, reach: int = 8, least: int = 8) -> DataFrame:
    """The offset at which a report's lines agree best with a file's: key, offset, n_agree, n_probes.

    probes: key, line, text; lines: key, line, text. Probes of fewer characters, or that the file doesn't hold anywhere,
    count for nothing; of equal offsets the smallest wins. A non-zero offset means another version of the file."""
    trimmed = lambda df, at, out: df.select(key, F.col("line").alias(at), F.trim("text").alias(out))
    p = trimmed(probes, "_p", "_t").where(F.length("_t") >= least)
    f = trimmed(lines, "_l", "_t")
    hits = p.join(f, [key, "_t"])  # by text: only equal lines meet
    n = hits.groupBy(key).agg(F.count_distinct("_p").alias("n_probes"))
    per = hits.withColumn("offset", F.col("_l") - F.col("_p")).where(F.abs("offset") <= reach).groupBy(key, "offset").agg(F.count("*").alias("_n"))
    best = per.groupBy(key).agg(F.max(F.struct("_n", (-F.col("offset")).alias("_o"))).alias("_b"))
    return best.join(n, key).select(key, (-F.col("_b._o")).alias("offset"), F.col("_b._n").alias("n_agree"), "n_probes")


def snippets(points: DataFrame, lines: DataFrame, point: str, key: str, radius: int) -> DataFrame:
    """The lines within the radius of each point as one text, in order: point, first_line, last_line, snippet.

    points: point, key, at; lines: key, line, text."""
    near = band_join(points.select(point, key, "at"), lines.select(key, "line", "text"), "at", "line", radius, [key])
    per = near.groupBy(point).agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.array_sort(F.collect_list(F.struct("line", "text"))).alias("_l"))
    return per.select(point, "first_line", "last_line", F.array_join(F.transform("_l", lambda x: x["text"]), "\n").alias("snippet"))


def interprocedural_slice(edges: DataFrame, seeds: DataFrame, refused: DataFrame | None = None, max_hops: int = 10) -> DataFrame:
    """Backward slice whose depth counts hops between functions only: node, hops.

    edges: src, dst, kind ('data', 'control' or 'call'); seeds: node; refused: node, predicates on branches that the path
    did not take, which neither come in over control edges nor stay. A level's closure inside functions is taken before the
    next hop, so every node has its least number of hops."""
    back = edges.select(F.col("dst").alias("node"), F.col("src").alias("_to"), "kind")
    if refused is not None:
        no = refused.select(F.col("node").alias("_to"), F.lit(True).alias("_no")).distinct()
        back = back.join(no, "_to", "left").where("kind <> 'control' OR _no IS NULL").select("node", "_to", "kind")
    back = settle(back)
    inside, between = back.where("kind <> 'call'"), back.where("kind = 'call'")
    found, level = None, seeds.select("node").where("node IS NOT NULL").distinct()
    for hop in range(max_hops + 1):
        step = lambda moving, _: inside.join(moving, "node").select(F.col("_to").alias("node"))
        level = fixpoint(level, step, ["node"])
        if found is not None:
            level = settle(level.join(found.select("node"), "node", "left_anti"))
        if level.isEmpty():
            break
        here = level.withColumn("hops", F.lit(hop))
        found = settle(here if found is None else found.unionByName(here))
        level = between.join(level, "node").select(F.col("_to").alias("node")).distinct().join(found.select("node"), "node", "left_anti")
    if refused is not None:
        found = found.join(refused.select("node").distinct(), "node", "left_anti")
    return found


def enumerate_paths(branches: DataFrame, segment: str, most: int = MOST_PATHS, k: int = 3, greedy_above: int | None = GREEDY_ROOTS) -> DataFrame:
    """Paths through a segment's branches in the order of a depth-first walk: segment, path, decisions, S, C, V.

    branches: segment, position (pre-order), node, verdict, statements, variables (array), and if given is_taken (the
    direction of a consistent branch, else true), is_call, ancestors (array of nodes, else none). A contradictory branch
    and all below it are left out, a consistent one goes its way, others go both, true first. S adds statements and one per
    call, C counts calls, V adds the numbers of variables. Up to so many paths are walked; a path is decoded from its
    number, so no product is formed. With more roots than greedy_above, only the first path and those that turn one of the
    first 3k roots that may be turned are given; None walks every segment."""
    has = set(branches.columns)
    column = lambda name, default: F.coalesce(F.col(name), default) if name in has else default
    none = F.array().cast("array<string>")
    row = F.struct(
        "position", F.col("node").cast("string").alias("node"), F.coalesce("verdict", F.lit("insufficient_info")).alias("verdict"), column("is_taken", F.lit(True)).alias("way"), column("is_call", F.lit(False)).alias("call"),
        column("ancestors", none).alias("above"), (F.col("statements").cast("long") + column("is_call", F.lit(False)).cast("long")).alias("s"), F.size("variables").alias("v"),
    )
    per = branches.groupBy(segment).agg(F.array_sort(F.collect_list(row)).alias("_all"))
    per = per.withColumn("_gone", F.transform(F.filter("_all", lambda b: b["verdict"] == "contradictory"), lambda b: b["node"]))
    per = per.withColumn("_b", F.filter("_all", lambda b: (b["verdict"] != "contradictory") & ~F.arrays_overlap(b["above"], F.col("_gone"))))
    open_ = F.filter("_b", lambda b: b["verdict"] != "consistent")
    per = per.withColumns({"_open": F.transform(open_, lambda b: b["node"]), "_roots": F.transform(F.filter("_b", lambda b: F.size(b["above"]) == 0), lambda b: b["node"])})
    per = per.withColumns({"_k": F.size("_open"), "_greedy": F.lit(False) if greedy_above is None else F.size("_roots") > greedy_above})
    count = F.least(F.pow(F.lit(2.0), F.least(F.col("_k"), F.lit(62))), F.lit(float(most))).cast("long")
    turned = F.filter(F.slice("_roots", 1, 3 * k), lambda r: F.array_contains("_open", r))
    each = per.withColumn("_turned", turned).withColumn("path", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("_greedy"), F.size("_turned").cast("long")).otherwise(count - 1))))
    place = lambda b: F.array_position(F.col("_open"), b["node"])
    # a path's number is too small to turn any but the last 62 open branches
    shift = lambda b: F.least(F.col("_k") - place(b), F.lit(63)).cast("int")
    one = F.lit(1).cast("long")
    decoded = lambda b: F.when(shift(b) > 62, True).otherwise(F.call_function("shiftright", F.col("path"), shift(b)).bitwiseAND(one) == 0)
    greedy = lambda b: (F.col("path") == 0) | (F.array_position(F.col("_turned"), b["node"]) != F.col("path"))
    taken = lambda b: F.when(place(b) == 0, b["way"]).otherwise(F.when(F.col("_greedy"), greedy(b)).otherwise(decoded(b)))
    total = lambda field: F.aggregate("_b", F.lit(0).cast("long"), lambda t, b: t + b[field].cast("long"))
    return each.select(
        segment, "path", F.transform("_b", lambda b: F.struct(b["node"].alias("node"), taken(b).alias("taken"))).alias("decisions"), total("s").alias("S"), total("call").alias("C"), total("v").alias("V")
    )


def path_signature(decisions: DataFrame, report: str, segment: str, line: str, taken: str) -> DataFrame:
    """One text per report that names all decisions: seg0[L10:T,L12:F];seg1[...]."""
    mark = F.concat(F.lit("L"), F.col(line).cast("string"), F.when(F.col(taken), ":T").otherwise(":F"))
    per = decisions.groupBy(report, segment).agg(F.array_sort(F.collect_list(F.struct(F.col(line).alias("l"), mark.alias("m")))).alias("_m"))
    text = F.concat(F.lit("seg"), F.col(segment).cast("string"), F.lit("["), F.array_join(F.transform("_m", lambda x: x["m"]), ","), F.lit("]"))
    named = per.select(report, F.struct(F.col(segment).alias("s"), text.alias("t")).alias("_s"))
    return named.groupBy(report).agg(F.array_sort(F.collect_list("_s")).alias("_s")).select(report, F.array_join(F.transform("_s", lambda x: x["t"]), ";").alias("signature"))


def exclusive_groups(branches: DataFrame) -> DataFrame:
    """Branches 'name == number' of one function and name with at least two numbers: function_name, name, nodes, constants.

    branches: function_name, node, condition."""
    pattern = r"^\s*\(?\s*([A-Za-z_][\w.\->]*)\s*==\s*(-?\d+)\s*\)?\s*$"
    parsed = branches.withColumns({"name": F.regexp_extract("condition", pattern, 1), "_c": F.regexp_extract("condition", pattern, 2)}).where("name <> ''")
    per = parsed.groupBy("function_name", "name").agg(F.array_sort(F.collect_set("node")).alias("nodes"), F.array_sort(F.collect_set(F.col("_c").cast("long"))).alias("constants"))
    return per.where(F.size("constants") >= 2)


def rank_adapters(documents: DataFrame) -> DataFrame:
    """path, adapter of the format that a document's name and head speak for most; null on a tie at the top or without any sign."""
    head = F.substring("content", 1, 4096)
    name = F.lower(F.col("path"))
    scores = {
        "csa_html": F.when(head.contains("<!-- BUGTYPE") | head.rlike(r'class="msg msg'), 1.0).when(name.endswith(".html"), 0.3).otherwise(0.0),
        "sarif": F.when(head.rlike(r'"version"\s*:\s*"2\.1') & head.contains('"runs"'), 1.0).when(name.endswith(".sarif") | name.endswith(".sarif.json"), 0.6).otherwise(0.0),
        "cfg_text": F.when(head.rlike(r"\[B\d+ \((ENTRY|EXIT)\)\]"), 1.0).otherwise(0.0),
        "pdg_json": F.when(head.contains('"function_name"') & head.contains('"functions"'), 1.0).otherwise(0.0),
    }
    ranked = F.array_sort(F.array(*[F.struct((-s).alias("s"), F.lit(n).alias("n")) for n, s in scores.items()]))
    best, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    return documents.select("path", F.when((best["s"] < 0) & (best["s"] < second["s"]), best["n"]).alias("adapter"))


def close_over_names(wanted: DataFrame, definitions: DataFrame, present: DataFrame, most: int = 25, hits: int = 8, stop: tuple[str, ...] = ("main", "size", "begin", "data", "what")) -> DataFrame:
    """One new file for each wanted name that no present file defines, the first of its first hits, so many files in all: name, file.

    wanted: name; definitions: name, file, ordinal, qualified boolean (qualified ones come first); present: file. Names of
    fewer than four characters and common words bring nothing in. The limit is the feature: it bounds what is built."""
    asked = wanted.where(F.length("name") >= 4).where(~F.col("name").isin(*stop)).select("name").distinct()
    w = Window.partitionBy("name").orderBy((~F.col("qualified")).cast("int"), "ordinal", "file")
    near = definitions.join(asked, "name").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= hits)
    here = near.join(present.select("file").distinct(), "file", "left_semi").select("name").distinct()
    fresh = near.join(here, "name", "left_anti").groupBy("name").agg(F.min(F.struct("_r", "file"))["file"].alias("file"))
    return fresh.groupBy("file").agg(F.min("name").alias("name")).orderBy("name").limit(most).select("name", "file")


def evaluate(expression: str | None, facts: dict[str, str] | None) -> bool | None:
    """The truth of a C condition under known names, by C's rules; null where it isn't known."""
    return truth(expression, facts)


def evaluated(expression: Column, facts: Column) -> Column:
    """evaluate() over columns: a text and a map of texts. Nested brackets are no regular language, hence the Arrow batches."""

    @pandas_udf("boolean")
    def run(texts: pd.Series, maps: pd.Series) -> pd.Series:
        return pd.Series([evaluate(t, dict(m) if m is not None else None) for t, m in zip(texts, maps)], dtype="object")

    return run(expression, facts)


def repair(text: str | None) -> tuple[str | None, bool]:
    """The JSON object in a text, whole or as the longest prefix that closing brackets make whole, and whether it was cut; (None, True) if there is none."""
    if not text or "{" not in text:
        return None, True
    body = text[text.index("{") :]
    try:
        found, _ = json.JSONDecoder().raw_decode(body)
        return json.dumps(found, sort_keys=True), False
    except ValueError:
        pass
    stops, stack, quoted, escaped = [], [], False, False
    for i, c in enumerate(body):
        if quoted:
            quoted, escaped = (True, not escaped) if c == "\\" and not escaped else (c != '"' or escaped, False)
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
        if not quoted:
            stops.append((i + 1, "".join(reversed(stack))))
    for end, close in reversed(stops):
        try:
            return json.dumps(json.loads(body[:end].rstrip().rstrip(",") + close), sort_keys=True), True
        except ValueError:
            continue
    return None, True


def repaired(text: Column) -> Column:
    """struct(document, degraded) of a text that should hold a JSON object."""

    @pandas_udf("struct<document: string, degraded: boolean>")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([repair(t) for t in texts], columns=["document", "degraded"])

    return run(text)
