"""Ladders that find out what a name in a report stands for: files, functions, definitions, and the file of an event.

Each rung is a weaker claim than the one before. A rung is one equality join with an index that has one row a key, so a name
that is everywhere costs no more than any other; the best rung decides per asked name. Paths are compared by their last
components: every suffix of a path is one hash, folded from its end, so an index grows with the components of paths, not
with their characters times their components; texts decide behind the hash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.graph import settle

STRATEGIES = ("direct", "build-prefix", "relative", "suffix", "basename")
#: Strategies that say where a file lies, not only how it is called.
STRONG = ("direct", "build-prefix", "relative", "suffix")
#: Endings of the files that may define a class, in order.
SOURCE_ENDINGS = (".cc", ".cpp", ".c")
_SEED = 42
#: Template arguments may be nested so deep.
_NESTED = 8


def components(path: Column) -> Column:
    """The components of a path, without empty ones and single dots."""
    return F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: ~p.isin("", "."))


def _suffix_hashes(parts: Column) -> Column:
    """One hash for each suffix of the components, the whole first."""
    folded = F.aggregate(F.reverse(parts), F.array(F.lit(_SEED).cast("long")), lambda held, p: F.concat(F.array(F.xxhash64(p, held[0])), held))
    return F.slice(folded, 1, F.size(parts))


def _below(folder: str, hashed: Column) -> Column:
    """The hash of folder/suffix from that of the suffix."""
    for part in reversed([p for p in folder.split("/") if p not in ("", ".")]):
        hashed = F.xxhash64(F.lit(part), hashed)
    return hashed


def resolve_files(reported: DataFrame, tree: DataFrame, root: str, prefixes: Sequence[str] = (), bases: Sequence[str] = (), embedded: DataFrame | None = None) -> DataFrame:
    """reported, strategy, local, rivals: the local file that each distinct reported path stands for.

    reported: reported; tree: local, the absolute paths of all files at hand; embedded: reported, the paths whose source the
    report carries. Rungs, in order: direct (an absolute path at hand), build-prefix (below root, behind the longest
    prefix first), relative (a relative path below root, then below the bases), suffix (the longest end of the path that
    lies below root), basename (the least file of that name; rivals counts all of them, and more than one means doubt),
    embedded, unresolved. Behind a prefix and for relative paths leading components are dropped until a file is met. Blank
    and null paths are unresolved."""
    raw = F.trim(F.coalesce(F.col("reported"), F.lit("")))
    asked = reported.select("reported").distinct().withColumns({"raw": raw, "parts": components(raw)})
    files = tree.select("local").distinct().withColumn("parts", components(F.col("local")))
    absolute = F.startswith("raw", F.lit("/"))

    def ways(rank: int, order: int, text: Column, folder: str, when: Column) -> Column:
        parts = components(text)
        places = F.transform(_suffix_hashes(parts), lambda h, i: F.struct(F.lit(rank).alias("rank"), F.lit(order).alias("order"), i.alias("cut"), _below(folder, h).alias("h"), F.lit(folder.rstrip("/")).alias("folder"), F.array_join(F.slice(parts, i + 1, F.size(parts)), "/").alias("rest")))
        return F.when(when, places).otherwise(F.array().cast("array<struct<rank:int,order:int,cut:int,h:bigint,folder:string,rest:string>>"))

    rungs = [ways(1, i, F.substring("raw", len(p) + 1, 1 << 20), root, F.startswith("raw", F.lit(p))) for i, p in enumerate(sorted(prefixes, key=len, reverse=True))]
    rungs += [ways(2, i, F.col("raw"), b, ~absolute) for i, b in enumerate([root, *bases])]
    rungs.append(ways(3, 0, F.col("raw"), root, F.lit(True)))
    index = files.select(F.element_at(_suffix_hashes(F.col("parts")), 1).alias("h"), "local").where("h IS NOT NULL")
    cells = asked.where("raw <> ''").select("reported", F.explode(F.concat(*rungs)).alias("w")).select("reported", "w.*")
    met = cells.join(index, "h").where(F.col("local") == F.concat("folder", F.lit("/"), "rest"))
    found = met.select("reported", F.struct("rank", "order", "cut", "local").alias("best"))
    same = asked.where(absolute).join(files.select(F.col("local").alias("raw")), "raw").select("reported", F.struct(F.lit(0).alias("rank"), F.lit(0).alias("order"), F.lit(0).alias("cut"), F.col("raw").alias("local")).alias("best"))
    best = found.unionByName(same).groupBy("reported").agg(F.min("best").alias("best"))
    named = files.groupBy(F.element_at("parts", -1).alias("base")).agg(F.min("local").alias("first"), F.count("*").alias("rivals"))
    told = asked.withColumn("base", F.try_element_at("parts", F.lit(-1))).join(best, "reported", "left").join(named, "base", "left")
    if embedded is not None:
        told = told.join(embedded.select("reported", F.lit(True).alias("carried")).distinct(), "reported", "left")
    else:
        told = told.withColumn("carried", F.lit(False))
    strategy = F.when(F.col("best").isNotNull(), F.element_at(F.array(*[F.lit(s) for s in STRATEGIES]), F.col("best.rank") + 1))
    strategy = strategy.when(F.col("first").isNotNull(), "basename").when(F.col("carried"), "embedded").otherwise("unresolved")
    weak = F.col("best").isNull() & F.col("first").isNotNull()
    return told.select("reported", strategy.alias("strategy"), F.coalesce("best.local", "first").alias("local"), F.when(weak, F.col("rivals")).otherwise(0).alias("rivals"))


def method_name(signature: Column) -> Column:
    """The last component of a function's name in a signature: parameters, template arguments, return type and marks go."""
    bare = signature
    for _ in range(_NESTED):
        bare = F.regexp_replace(bare, r"<[^<>]*>", "")
    word = F.element_at(F.split(F.trim(F.substring_index(bare, "(", 1)), r"\s+"), -1)
    return F.regexp_replace(F.element_at(F.split(word, "::"), -1), r"^[*&]+", "")


def _tails(name: Column) -> Column:
    """The proper `::` suffixes of a qualified name."""
    parts = F.split(name, "::")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "::"))).otherwise(F.array().cast("array<string>"))


def resolve_functions(asked: DataFrame, known: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """ask, strategy, target: the graph function that each asked name stands for.

    asked: ask, name, caller; known: name, ordinal; calls: caller, callee, ordinal. Rungs: exact, suffix (the name after a
    `::`), method (the short name of a signature against known short names), then through the caller's own callees:
    callee (equal to the name or ending in it), mention (holding it). The first known of a rung is taken, in the order of
    ordinals. Null names are unresolved."""
    first = F.min(F.struct("ordinal", F.col("target"))).alias("b")
    names = known.select("ordinal", F.col("name").alias("target"))
    exact = names.groupBy(F.col("target").alias("name")).agg(first)
    suffix = names.select("ordinal", "target", F.explode(_tails(F.col("target"))).alias("name")).groupBy("name").agg(first)
    method = names.select("ordinal", "target", method_name(F.col("target")).alias("short")).groupBy("short").agg(first)
    wanted = asked.select("name").where("name IS NOT NULL").distinct().withColumn("short", method_name(F.col("name")))
    wanted = wanted.join(exact.withColumnRenamed("b", "b0"), "name", "left").join(suffix.withColumnRenamed("b", "b1"), "name", "left").join(method.withColumnRenamed("b", "b2"), "short", "left")
    rungs, told = ["exact", "suffix", "method"], asked.join(wanted, "name", "left")
    if calls is not None:
        # only what the ladder left open, one (caller, name) once
        open_ = told.where("b0 IS NULL AND b1 IS NULL AND b2 IS NULL AND name IS NOT NULL AND name <> ''").select("caller", "name").distinct()
        once = calls.groupBy("caller", "callee").agg(F.min("ordinal").alias("ordinal"))
        met = open_.join(once, "caller").where(F.contains("callee", "name"))
        ends = (F.col("callee") == F.col("name")) | F.endswith("callee", F.concat(F.lit("::"), "name"))
        pick = lambda c: F.min(F.when(c, F.struct("ordinal", F.col("callee").alias("target"))))
        told = told.join(met.groupBy("caller", "name").agg(pick(ends).alias("b3"), pick(~ends).alias("b4")), ["caller", "name"], "left")
        rungs += ["callee", "mention"]
    strategy, best = F.lit("unresolved"), F.lit(None).cast("string")
    for i in reversed(range(len(rungs))):
        strategy, best = F.when(F.col(f"b{i}").isNotNull(), rungs[i]).otherwise(strategy), F.coalesce(F.col(f"b{i}.target"), best)
    return told.select("ask", strategy.alias("strategy"), best.alias("target"))


def folder(path: Column) -> Column:
    """What a path has before its last slash; empty without one."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def pick_definitions(asked: DataFrame, definitions: DataFrame) -> DataFrame:
    """ask, tier, file, first_line, last_line: the definition nearest to where a name is asked from.

    asked: ask, name (qualified or not), hint (a file, a folder or null); definitions: name (short), file, ordinal,
    first_line, last_line. Tiers: file (defined in the hint itself), folder (in the hint or beside it), first; within one
    the least ordinal. Names without a definition are left out."""
    place = F.struct("ordinal", "file", "first_line", "last_line")
    per = lambda *by: definitions.groupBy("name", *by).agg(F.min(place).alias("b"))
    wanted = asked.select("ask", "hint", F.element_at(F.split(F.trim("name"), "::"), -1).alias("name"))
    own = per("file").select("name", F.col("file").alias("hint"), F.col("b").alias("b0"))
    beside = per(folder(F.col("file")).alias("at")).select("name", "at", F.col("b").alias("b1"))
    inside = beside.select("name", F.col("at").alias("hint"), F.col("b1").alias("b2"))
    told = wanted.join(per().withColumnRenamed("b", "b3"), "name").join(own, ["name", "hint"], "left").join(inside, ["name", "hint"], "left")
    told = told.withColumn("at", folder(F.col("hint"))).join(beside, ["name", "at"], "left")
    near = F.coalesce("b2", "b1")
    tier = F.when(F.col("b0").isNotNull(), "file").when(near.isNotNull(), "folder").otherwise("first")
    best = F.coalesce(F.col("b0"), near, F.col("b3"))
    return told.select("ask", tier.alias("tier"), best["file"].alias("file"), best["first_line"].alias("first_line"), best["last_line"].alias("last_line"))


def called_class(description: Column) -> Column:
    """The class of a qualified method that a call event names, null if it names none."""
    quoted = F.split(description, "'")
    said = F.endswith(F.trim(F.get(quoted, F.lit(0))), F.lit("Calling"))
    owner = F.split(F.get(quoted, F.lit(1)), "::")
    return F.when(said & (F.size(owner) > 1) & F.get(owner, F.lit(0)).rlike(r"^\w+$"), F.get(owner, F.lit(0)))


def class_files(events: DataFrame, reports: DataFrame, tree: DataFrame, root: str) -> DataFrame:
    """report, class, file: the file named like a class that a report's calls name, beside the bug's file, then below root/src,
    then in root itself, with the first of SOURCE_ENDINGS.

    events: report, description; reports: report, bug_file (null if there is none); tree: local."""
    asked = events.select("report", called_class(F.col("description")).alias("class")).where("class IS NOT NULL").distinct().join(reports.select("report", "bug_file"), "report", "left")
    places = [F.concat(folder(F.col("bug_file")), F.lit("/")), F.lit(f"{root}/src/"), F.lit(f"{root}/")]
    ways = F.explode(F.array(*[F.struct(F.lit(i * len(SOURCE_ENDINGS) + k).alias("rank"), F.concat(p, "class", F.lit(e)).alias("local")) for i, p in enumerate(places) for k, e in enumerate(SOURCE_ENDINGS)]))
    met = asked.select("report", "class", ways.alias("w")).select("report", "class", "w.*").join(tree.select("local").distinct(), "local")
    return met.groupBy("report", "class").agg(F.min_by("local", "rank").alias("file"))


def event_files(events: DataFrame, reports: DataFrame, lines: DataFrame, classes: DataFrame) -> DataFrame:
    """report, event, file, how: the file that each event lies in.

    events: report, event, line, description, file (null where the report's own couldn't be placed); reports: report,
    bug_file; lines: file, line, ordinal (the lines that have graph nodes, in their order); classes: report, class, file
    (class_files). In order: own; class (the file of the class a call names); line (the file with a node on that line, of
    the report's files if one of these has it; of several the one named like the called class, else the first); bug.

    A class whose file is found so belongs to the report's files, and these decide the line look-ups: an event placed by
    its line in a file of the report makes no new file known, one placed elsewhere does, so the look-up is repeated with
    these files. Twice is enough: a line that no known file has makes one known that has it, so none is left the second time.
    A file's line counts once however many nodes lie on it, and only lines that a report asks for meet its files."""
    named = events.select("report", "event", "line", "file", called_class(F.col("description")).alias("class")).join(classes.withColumnRenamed("file", "class_file"), ["report", "class"], "left")
    how = F.when(F.col("file").isNotNull(), "own").otherwise("class")
    done = settle(named.where("file IS NOT NULL OR class_file IS NOT NULL").select("report", "event", F.coalesce("file", "class_file").alias("file"), how.alias("how")))
    waiting = settle(named.where("file IS NULL AND class_file IS NULL AND line > 0").select("report", "event", "line", "class"))
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", "")
    places = settle(lines.groupBy("file", "line").agg(F.min("ordinal").alias("ordinal")).withColumn("stem", stem))
    anywhere = settle(places.groupBy("line").agg(F.min_by("file", "ordinal").alias("any_file")))
    asked = settle(waiting.select("report", "line").distinct().join(anywhere, "line"))
    with_lines = places.select("file").distinct()

    def inside(known: DataFrame) -> DataFrame:
        met = known.join(with_lines, "file", "left_semi").join(asked.select("report", "line"), "report").join(places.select("file", "line", "ordinal"), ["file", "line"])
        return met.groupBy("report", "line").agg(F.min_by("file", "ordinal").alias("in_file"))

    known = settle(done.select("report", "file").distinct())
    elsewhere = asked.join(inside(known), ["report", "line"], "left_anti").select("report", F.col("any_file").alias("file"))
    known = settle(known.unionByName(elsewhere).distinct())
    alike = waiting.select("report", "line", "class").where("class IS NOT NULL").distinct().join(places.withColumnRenamed("stem", "class"), ["line", "class"])
    alike = alike.join(known, ["report", "file"], "left_semi").groupBy("report", "line", "class").agg(F.min_by("file", "ordinal").alias("like"))
    met = waiting.join(inside(known), ["report", "line"]).join(alike, ["report", "line", "class"], "left")
    told = settle(met.select("report", "event", F.coalesce("like", "in_file").alias("file"), F.lit("line").alias("how")))
    rest = events.select("report", "event").join(done.unionByName(told).select("report", "event"), ["report", "event"], "left_anti").join(reports.select("report", F.col("bug_file").alias("file")), "report", "left")
    return done.unionByName(told).unionByName(rest.select("report", "event", "file", F.lit("bug").alias("how")))
