"""Slices over calls: matched call and return, the reported path's callers, and fields along a chain of callers.

Nodes are (function, node). A slice that enters a function by its return and leaves it by its parameters may only go on
at the call it came from. That is reachability over matched brackets, and it takes two plain searches: summary edges first
lead over calls, from an argument to the call's value, then one search goes up into callers only and one, from all it
found, down into callees only. Every search is a fix-point of joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.graph import fixpoint, settle, shortcuts

PAIR = ["function", "node"]
#: Functions of at most so many edges are crossed in one round.
CROSSED_EDGES = 256


def arguments(calls: DataFrame, data: DataFrame, defines: DataFrame) -> DataFrame:
    """function, call, callee, position, node: the nodes whose definitions an argument of a call carries.

    calls: function, call, callee (the function called), position, variable, a row an argument; data: function, src, dst,
    variable; defines: function, node, variable. These are the definitions that reach the call over data edges of the
    argument's variable; without one, every definition of it in the function. Unknown arguments (`?` or empty) carry none."""
    known = calls.where("variable IS NOT NULL AND variable NOT IN ('', '?')")
    edges = data.select("function", F.col("dst").alias("call"), "variable", F.col("src").alias("node"))
    reached = known.join(edges, ["function", "call", "variable"]).select("function", "call", "callee", "position", "node")
    open_ = known.join(reached.select("function", "call", "position").distinct(), ["function", "call", "position"], "left_anti")
    return reached.unionByName(open_.join(defines, ["function", "variable"]).select("function", "call", "callee", "position", "node")).distinct()


def _inside(data: DataFrame, control: DataFrame, calls: DataFrame, formals: DataFrame) -> DataFrame:
    """function, node, on: what a node depends on within its function. Data edges into a call are left to the arguments where
    their variable is only passed to known parameters."""
    places = formals.select(F.col("function").alias("callee"), "position").distinct().withColumn("_p", F.lit(1))
    passed = calls.join(places, ["callee", "position"], "left").groupBy("function", F.col("call").alias("dst"), "variable").agg(F.min(F.coalesce("_p", F.lit(0))).alias("_p")).where("_p = 1")
    own = data.join(passed, ["function", "dst", "variable"], "left_anti").select("function", F.col("dst").alias("node"), F.col("src").alias("on"))
    return own.unionByName(control.select("function", F.col("dst").alias("node"), F.col("src").alias("on"))).distinct()


def returning(inside: DataFrame, passed: DataFrame, formals: DataFrame, returns: DataFrame) -> DataFrame:
    """function, node: the nodes that a return of their own function depends on, calls followed to what their values depend on.

    passed: arguments(...); formals: function, position, node; returns: function, node. An argument counts as soon as both
    its call counts in the caller and its parameter in the callee; what it depends on in the caller then counts too, which
    may make further arguments count, until none does."""
    waits = passed.join(formals.select(F.col("function").alias("callee"), "position", F.col("node").alias("formal")), ["callee", "position"])
    waits = settle(waits.select("function", "call", "callee", "formal", "node").distinct())
    inside = settle(inside)
    known = fixpoint(returns.select(*PAIR).distinct(), lambda moving, _: inside.join(moving, PAIR).select("function", F.col("on").alias("node")), PAIR)
    while True:
        by_call, by_formal = known.select("function", F.col("node").alias("call")), known.select(F.col("function").alias("callee"), F.col("node").alias("formal"))
        ripe = waits.join(by_call, ["function", "call"], "left_semi").join(by_formal, ["callee", "formal"], "left_semi")
        new = settle(ripe.select(*PAIR).distinct().join(known, PAIR, "left_anti"))
        if not new.take(1):
            return known
        met = known
        more = fixpoint(new, lambda moving, _, met=met: inside.join(moving, PAIR).select("function", F.col("on").alias("node")).join(met, PAIR, "left_anti"), PAIR)
        known = settle(known.unionByName(more))


def summary_edges(passed: DataFrame, formals: DataFrame, returning_nodes: DataFrame) -> DataFrame:
    """function, node, on: from a call to the arguments that its value depends on."""
    counts = formals.join(returning_nodes, PAIR).select(F.col("function").alias("callee"), "position")
    return passed.join(counts, ["callee", "position"], "left_semi").select("function", F.col("call").alias("node"), F.col("node").alias("on")).distinct()


def _searched(start: DataFrame, edges: DataFrame) -> DataFrame:
    edges = settle(edges.select("function", "node", "to_function", "to_node").distinct())
    return fixpoint(start, lambda moving, _: edges.join(moving, PAIR).select(F.col("to_function").alias("function"), F.col("to_node").alias("node")), PAIR)


def _hop(edges: DataFrame) -> DataFrame:
    return edges.select("function", "node", F.col("function").alias("to_function"), F.col("on").alias("to_node"))


def context_slice(seeds: DataFrame, data: DataFrame, control: DataFrame, calls: DataFrame, formals: DataFrame, returns: DataFrame, defines: DataFrame) -> DataFrame:
    """function, node: all that the seeds (function, node) depend on by ways whose calls and returns match.

    data: function, src, dst, variable; control: function, src, dst; calls: function, call, callee, position, variable;
    formals: function, position, node (the node that stands for a parameter); returns: function, node; defines: function,
    node, variable. Of a call to a known function only the arguments count that its value depends on; a call to an unknown
    one depends on all that reaches it. Functions may call one another in circles."""
    calls = settle(calls)
    called = settle(calls.select(F.col("callee").alias("function")).where("function IS NOT NULL").distinct())
    of = lambda df, functions: df.join(functions, "function", "left_semi")
    own = lambda functions: _inside(of(data, functions), of(control, functions), of(calls, functions), formals)
    # what a call leads through is asked for in called functions alone; of the others only those that are reached are crossed
    formals = settle(of(formals, called))
    passed = settle(arguments(calls, data, defines))
    inside = settle(own(called))
    known = settle(returning(shortcuts(inside, "function", CROSSED_EDGES), of(passed, called), formals, of(returns, called)))
    summaries = settle(summary_edges(passed, formals, known))
    back = settle(shortcuts(inside.unionByName(of(summaries, called)).distinct(), "function", CROSSED_EDGES).select("function", F.col("on").alias("node"), F.col("node").alias("from")))
    # function, node, formal: the parameters that a node of a called function depends on
    led = formals.select("function", "node", F.col("node").alias("formal")).distinct()
    led = settle(fixpoint(led, lambda moving, _: back.join(moving, PAIR).select("function", F.col("from").alias("node"), "formal"), ["function", "node", "formal"]))
    places = formals.select(F.col("function").alias("callee"), "position", F.col("node").alias("formal"))
    up = passed.join(places, ["callee", "position"]).select(F.col("callee").alias("function"), "formal", F.col("function").alias("to_function"), F.col("node").alias("to_node"))
    sites = calls.select("function", F.col("call").alias("node"), "callee").distinct()
    # a parameter also tells that the call was made: its site comes in for what decides whether it is reached
    made = sites.join(places, "callee").select(F.col("callee").alias("function"), "formal", F.col("function").alias("to_function"), F.col("node").alias("site"))
    reach = made.join(control.select(F.col("function").alias("to_function"), F.col("dst").alias("site"), F.col("src").alias("to_node")), ["to_function", "site"]).select("function", "formal", "to_function", "to_node")
    up = settle(up.unionByName(reach).distinct())

    def climb(moving: DataFrame, _: int) -> DataFrame:
        through = led.join(moving, PAIR).select("function", "formal").distinct()
        return up.join(through, ["function", "formal"]).select(F.col("to_function").alias("function"), F.col("to_node").alias("node"))

    entered = fixpoint(seeds.select(*PAIR).distinct(), climb, PAIR)
    there = settle(entered.select("function").distinct())
    over = settle(shortcuts(own(there).unionByName(of(summaries, there)).distinct(), "function", CROSSED_EDGES))
    first = settle(fixpoint(entered.select(*PAIR), lambda moving, _: over.join(moving, PAIR).select("function", F.col("on").alias("node")), PAIR))
    # down into callees only: a called function counts with all that its returns depend on
    onward = settle(known.join(sites, PAIR).select("function", F.col("callee").alias("next")).distinct())
    down = fixpoint(first.join(sites, PAIR).select(F.col("callee").alias("function")).distinct(), lambda moving, _: onward.join(moving, "function").select(F.col("next").alias("function")), ["function"])
    return first.unionByName(of(known, down).select(*PAIR)).distinct()


def owner(function: Column) -> Column:
    """The class of a qualified method, null for a free function."""
    parts = F.split(function, "::")
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "::"))


def caller_chain(callers: DataFrame) -> DataFrame:
    """function, callee, caller, steps: every call up the chain from a function, each pair of one caller and what it calls.

    callers: function, caller, the one caller that a function has on the reported path. A chain that comes back to a
    function ends there."""
    own = callers.where("caller IS NOT NULL AND function <> caller").groupBy("function").agg(F.min("caller").alias("caller"))
    own = settle(own)
    start = own.select("function", F.col("function").alias("callee"), "caller", F.lit(1).alias("steps"))

    def step(moving: DataFrame, done: int) -> DataFrame:
        further = own.select(F.col("function").alias("callee"), F.col("caller").alias("next"))
        up = moving.select("function", F.col("caller").alias("callee")).join(further, "callee")
        return up.where("callee <> function").select("function", "callee", F.col("next").alias("caller"), F.lit(done + 1).alias("steps"))

    return fixpoint(start, step, ["function", "callee"])


def _object(expression: Column, short: Column) -> Column:
    """What a method is called on in an expression: the word before `->name`, else before `.name`; null where there is none."""

    def before(mark: str) -> Column:
        called = F.concat(F.lit(mark), short)
        ahead = F.call_function("substring_index", expression, called, F.lit(1))
        return F.when(F.contains(expression, called), F.nullif(F.regexp_extract(ahead, r"(\w+)\W*$", 1), F.lit("")))

    return F.coalesce(before("->"), before("."))


def field_climbs(uses: DataFrame, defines: DataFrame, chain: DataFrame, sites: DataFrame, constructors: DataFrame) -> DataFrame:
    """function, node, to_function, to_node: where the value of a field of this comes from that its function doesn't set.

    uses: function, node, variable (`[this].field`); defines: function, node, variable; chain: caller_chain; sites:
    function, call, callee, expression, the calls of each function; constructors: function, node, object, constructor, the
    nodes where an object is made. At each step up the chain: in a caller of the same class that calls on this, the
    definitions of the field; in one that calls on an object it made by the class's own constructor, the constructor's
    definitions and the node that made it."""
    local = defines.select("function", "variable").distinct()
    open_ = uses.where(F.startswith("variable", F.lit("[this]."))).join(local, ["function", "variable"], "left_anti")
    short = F.element_at(F.split(F.substring_index("callee", "<", 1), "::"), -1)
    named = sites.select(F.col("function").alias("caller"), "callee", "expression").groupBy("caller", "callee").agg(F.min("expression").alias("expression"))
    steps = open_.join(chain, "function").join(named, ["caller", "callee"], "left")
    steps = steps.withColumns({"on": _object(F.coalesce("expression", F.lit("")), short), "class": owner(F.col("callee"))})
    itself = (F.col("class") == owner(F.col("caller"))) & (F.col("on").isNull() | (F.lower("on") == "this"))
    sets = defines.select(F.col("function").alias("to_function"), "variable", F.col("node").alias("to_node"))
    same = steps.where(itself).withColumn("to_function", F.col("caller")).join(sets, ["to_function", "variable"]).select("function", "node", "to_function", "to_node")
    last = lambda c: F.element_at(F.split(F.substring_index(c, "<", 1), "::"), -1)
    made = constructors.select(F.col("function").alias("caller"), F.col("object").alias("on"), F.col("node").alias("maker"), "constructor")
    built = steps.where("class IS NOT NULL AND on IS NOT NULL AND lower(on) <> 'this'").join(made, ["caller", "on"]).where(last(F.col("constructor")) == last(F.col("class")))
    there = built.withColumn("to_function", F.col("constructor")).join(sets, ["to_function", "variable"]).select("function", "node", "to_function", "to_node")
    return same.unionByName(there).unionByName(built.select("function", "node", F.col("caller").alias("to_function"), F.col("maker").alias("to_node"))).distinct()


def path_slice(
    seeds: DataFrame, data: DataFrame, control: DataFrame, callers: DataFrame, calls: DataFrame, formals: DataFrame, defines: DataFrame,
    refused: DataFrame | None = None, climbs: DataFrame | None = None,
) -> DataFrame:
    """function, node: what the seeds depend on along the reported path.

    A parameter leads to the definitions of its argument, and to the call, in the one caller that the path has (callers:
    function, caller), at that caller's first call of it (calls: function, call, callee, position, variable, ordinal).
    refused: function, node, the predicates on branches not taken; they don't come in over control edges and don't stay.
    climbs: field_climbs."""
    if refused is not None:
        off = refused.select("function", F.col("node").alias("src")).distinct()
        control = control.join(off, ["function", "src"], "left_anti")
    inside = data.select("function", F.col("dst").alias("node"), F.col("src").alias("on")).unionByName(control.select("function", F.col("dst").alias("node"), F.col("src").alias("on")))
    own = callers.groupBy(F.col("function").alias("callee")).agg(F.min("caller").alias("function"))
    first = calls.join(own, ["callee", "function"]).groupBy("callee", "function").agg(F.min_by("call", "ordinal").alias("call"))
    site = calls.join(first, ["callee", "function", "call"])
    places = formals.select(F.col("function").alias("callee"), "position", F.col("node").alias("formal"))
    entered = site.join(places, ["callee", "position"]).where("variable IS NOT NULL AND variable NOT IN ('', '?')")
    to_call = entered.select(F.col("callee").alias("function"), F.col("formal").alias("node"), F.col("function").alias("to_function"), F.col("call").alias("to_node"))
    to_definition = entered.join(defines.withColumnRenamed("node", "_def"), ["function", "variable"]).select(F.col("callee").alias("function"), F.col("formal").alias("node"), F.col("function").alias("to_function"), F.col("_def").alias("to_node"))
    edges = _hop(inside).unionByName(to_call).unionByName(to_definition)
    if climbs is not None:
        edges = edges.unionByName(climbs)
    found = _searched(seeds.select(*PAIR).distinct(), edges)
    return found.join(refused.select(*PAIR).distinct(), PAIR, "left_anti") if refused is not None else found
