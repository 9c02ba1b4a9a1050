"""Constants traced from arguments to parameters, fields, getters and options: a fix-point over a lattice.

What a slot holds is a constant, a conflict of several, or unknown, in this order; it only ever rises, two steps at most. A
round sends on the slots that rose, merged where they go to before they are looked up, so a slot that thousands of call
sites feed takes one row a round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.constraints import to_number
from strandline.operators.graph import Grown, settle

STATES = ("constant", "conflict", "unknown")


def _merged(rows: DataFrame) -> DataFrame:
    """slot, kind, value of rows of these columns: the least state above all of a slot's rows."""
    top = F.max("kind")
    kind = F.when(top == 2, 2).when((top == 1) | (F.min("value") != F.max("value")), 1).otherwise(0)
    per = rows.groupBy("slot").agg(kind.alias("kind"), F.min("value").alias("value"))
    return per.select("slot", "kind", F.when(F.col("kind") == 0, F.col("value")).alias("value"))


def trace_constants(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """slot, state, value: what reaches each slot.

    seeds: slot, value, where a null value is unknown; edges: src, dst. Equal constants of several sources stay one,
    different ones make a conflict, an unknown source makes whatever it reaches unknown. Slots that nothing reaches are left
    out. Edges may run in circles."""
    hops = settle(edges.where("src IS NOT NULL AND dst IS NOT NULL").select(F.col("src").alias("slot"), "dst").distinct())
    start = seeds.where("slot IS NOT NULL").select("slot", F.when(F.col("value").isNull(), 2).otherwise(0).alias("kind"), "value")
    moving = settle(_merged(start))
    held = Grown(moving)
    while True:
        sent = _merged(moving.join(hops, "slot").select(F.col("dst").alias("slot"), "kind", "value"))
        now = _merged(held.table()).withColumnRenamed("kind", "_k").withColumnRenamed("value", "_v")
        kind = F.greatest("kind", F.coalesce("_k", F.lit(0)), F.when((F.col("kind") == 0) & (F.col("_k") == 0) & (F.col("value") != F.col("_v")), 1).otherwise(0))
        risen = sent.join(now, "slot", "left").withColumn("_new", kind).where("_k IS NULL OR _new > _k")
        moving = settle(risen.select("slot", F.col("_new").alias("kind"), F.when(F.col("_new") == 0, F.col("value")).alias("value")))
        if not (rows := moving.count()):
            break
        held.append(rows, moving)
    names = F.element_at(F.array(*[F.lit(s) for s in STATES]), F.col("kind") + 1)
    return _merged(held.table()).select("slot", names.alias("state"), "value")


def slot(kind: str, *parts: Column) -> Column:
    """The name of a slot: its kind and what tells it from others of the kind."""
    return F.concat_ws(":", F.lit(kind), *[p.cast("string") for p in parts])


def _argument_source(text: Column) -> Column:
    """struct(value, slot) of what an argument passes: a literal's value, or the slot of an option or of a getter; both null
    for anything else."""
    bare = F.trim(text)
    number, quoted = to_number(bare), F.regexp_extract(bare, r'^"([^"]*)"$', 1)
    literal = F.when(number.isNotNull(), bare).when(bare.rlike(r'^"[^"]*"$'), F.concat(F.lit('"'), quoted, F.lit('"')))
    option = F.regexp_extract(bare, r"\(\s*([A-Z][A-Z0-9]*_[A-Z0-9_]+)\s*\)$", 1)
    getter = F.regexp_extract(bare, r"(?:\.|->)([A-Za-z_]\w*)\(\s*\)$", 1)
    source = F.when(literal.isNotNull(), F.lit(None).cast("string")).when(option != "", slot("option", option)).when(getter != "", slot("getter", getter))
    return F.struct(literal.alias("value"), source.alias("slot"))


def traced_parameters(arguments: DataFrame, initializers: DataFrame, getters: DataFrame, options: DataFrame) -> DataFrame:
    """callee, position, state, value, sites: what all call sites together pass to each parameter.

    arguments: callee, position, text, a row a call site and argument; initializers: callee, position, field (the field a
    constructor sets from a parameter); getters: name, field (the field that a getter returns); options: name, value (the
    default). A literal is itself; an argument that reads an option or calls a getter takes what reaches that; getters of
    one name in several classes take what reaches any of their fields. Everything else, options without a default and
    getters without a field are unknown."""
    read = arguments.withColumn("_s", _argument_source(F.col("text")))
    to = slot("parameter", F.col("callee"), F.col("position"))
    passed = read.select(to.alias("slot"), F.col("_s.value").alias("value"), F.col("_s.slot").alias("source"))
    fixed = passed.where("source IS NULL").select("slot", "value").distinct()
    taken = passed.where("source IS NOT NULL").select(F.col("source").alias("src"), F.col("slot").alias("dst")).distinct()
    defaults = options.select(slot("option", F.col("name")).alias("slot"), "value")
    sets = initializers.select(to.alias("src"), slot("field", F.col("field")).alias("dst"))
    gives = getters.select(slot("field", F.col("field")).alias("src"), slot("getter", F.col("name")).alias("dst"))
    edges = settle(sets.unionByName(gives).unionByName(taken))
    seeds = settle(fixed.unionByName(defaults))
    # what is asked for but has no source at all is unknown
    fed = seeds.select("slot").unionByName(edges.select(F.col("dst").alias("slot"))).distinct()
    bare = edges.select(F.col("src").alias("slot")).distinct().join(fed, "slot", "left_anti").withColumn("value", F.lit(None).cast("string"))
    found = trace_constants(seeds.unionByName(bare), edges)
    sites = arguments.groupBy("callee", "position").agg(F.count("*").alias("sites")).withColumn("slot", to)
    return sites.join(found, "slot", "left").select("callee", "position", F.coalesce("state", F.lit("unknown")).alias("state"), "value", "sites")
