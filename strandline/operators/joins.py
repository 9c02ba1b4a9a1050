"""Look-ups and theta joins, each built on an equality join so that it spreads over the cluster.

Bands become joins on a bucket of the band's width; ladders of ever weaker matches become one join per rung or a ranked
union; "nothing in between" becomes a comparison of running counts instead of an anti-join over intervals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def band_join(left: DataFrame, right: DataFrame, left_at: str, right_at: str, width: int, keys: Sequence[str] = ()) -> DataFrame:
    """Pairs with |left_at - right_at| <= width and equal keys; column names must differ otherwise.

    Each left row goes to its bucket of the width and both neighbours, each right row to its own, so a pair meets once."""
    bucket = lambda c: F.floor(F.col(c) / width) if width else F.col(c)
    spread = left.withColumn("_bucket", F.explode(F.array(*[bucket(left_at) + i for i in ((-1, 0, 1) if width else (0,))])))
    placed = right.withColumn("_bucket", bucket(right_at))
    return spread.join(placed, [*keys, "_bucket"]).where(F.abs(F.col(left_at) - F.col(right_at)) <= width).drop("_bucket")


def _by_position(left: DataFrame, best: DataFrame, left_id: str, left_at: str, keys: Sequence[str]) -> DataFrame:
    """Each left row beside the answer of its position."""
    return left.select(left_id, *keys, left_at).join(best, [*keys, left_at])


def tiered_match(left: DataFrame, right: DataFrame, left_id: str, left_at: str, right_id: str, right_at: str, width: int, keys: Sequence[str] = ()) -> DataFrame:
    """Exact matches of a left row, or if it has none those within the band: left_id, tier, n_matches, first_match; one row per left row that has any.

    Both sides are brought down to their distinct positions before they meet, so the join grows with these, not with the rows."""
    held = right.groupBy(*keys, right_at).agg(F.count("*").alias("_n"), F.min(right_id).alias("_f"))
    near = band_join(left.select(*keys, left_at).distinct(), held, left_at, right_at, width, keys)
    tier = F.when(F.col(left_at) == F.col(right_at), 0).otherwise(1)
    per = near.groupBy(*keys, left_at, tier.alias("tier")).agg(F.sum("_n").alias("n_matches"), F.min("_f").alias("first_match"))
    best = per.groupBy(*keys, left_at).agg(F.min(F.struct("tier", "n_matches", "first_match")).alias("_b"))
    return _by_position(left, best, left_id, left_at, keys).select(left_id, "_b.tier", "_b.n_matches", "_b.first_match")


def nearest_match(left: DataFrame, right: DataFrame, left_id: str, left_at: str, right_id: str, right_at: str, width: int, keys: Sequence[str] = (), preferred: Column | None = None) -> DataFrame:
    """The closest right row within the band, its distance lessened by one where it is preferred; first id on ties: left_id, score, match.

    As in tiered_match, distinct positions meet, not rows."""
    bonus = F.when(preferred, 1).otherwise(0) if preferred is not None else F.lit(0)
    held = right.groupBy(*keys, right_at, bonus.alias("_bonus")).agg(F.min(right_id).alias("_f"))
    near = band_join(left.select(*keys, left_at).distinct(), held, left_at, right_at, width, keys)
    score = F.abs(F.col(left_at) - F.col(right_at)) - F.col("_bonus")
    best = near.groupBy(*keys, left_at).agg(F.min(F.struct(score.alias("score"), F.col("_f").alias("match"))).alias("_b"))
    return _by_position(left, best, left_id, left_at, keys).select(left_id, "_b.score", "_b.match")


def contradictions(claims: DataFrame, key: str, order: list[str], condition: str, direction: Column, blocker: Column, event: str) -> DataFrame:
    """Pairs of claims of one condition with opposite directions and no blocking event between: key, condition, first_event, second_event.

    Blockers are counted along the trace: two claims with equal counts have none between, so the interval test becomes an
    equality join on (key, condition, count), and the true claims meet the false ones only. Blockers make no claims, and
    claims of unknown direction contradict nothing."""
    running = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = claims.withColumns({"_n": F.sum(F.when(blocker, 1).otherwise(0)).over(running), "_dir": direction, "_blocks": F.coalesce(blocker, F.lit(False))}).where("NOT _blocks")
    side = lambda taken, name: counted.where(F.col("_dir") if taken else ~F.col("_dir")).select(key, condition, "_n", F.struct(*order, F.col(event).alias("e")).alias(name))
    pairs = side(True, "_t").join(side(False, "_f"), [key, condition, "_n"])
    return pairs.select(key, condition, F.least("_t", "_f")["e"].alias("first_event"), F.greatest("_t", "_f")["e"].alias("second_event"))


def kth_pairing(left: DataFrame, right: DataFrame, keys: Sequence[str], order: list[str], left_id: str, right_id: str) -> DataFrame:
    """The k-th left row with the k-th right row of each key, for keys that have as many of both: keys, k, left_event, right_event."""
    w = Window.partitionBy(*keys)
    number = lambda df, name, out: df.select(*keys, F.row_number().over(w.orderBy(*order)).alias("k"), F.count("*").over(w).alias("_n"), F.col(name).alias(out))
    return number(left, left_id, "left_event").join(number(right, right_id, "right_event"), [*keys, "k", "_n"]).drop("_n")


def ranked_resolution(asked: DataFrame, known: DataFrame, ask_id: str, rungs: Sequence[tuple[Column, Column]], target: str) -> DataFrame:
    """Resolve each asked row by the first rung of (asked key, known key) that has a match, the least target on ties: ask_id, strategy, target.

    Unresolved rows keep a null target and strategy -1, so that callers can fall back conservatively."""
    found = None
    for rank, (ask, know) in enumerate(rungs):
        index = known.select(know.alias("_k"), F.col(target).alias("_t")).where("_k IS NOT NULL").groupBy("_k").agg(F.min("_t").alias("_t"))
        hit = asked.select(F.col(ask_id), ask.alias("_k")).join(index, "_k").select(ask_id, F.struct(F.lit(rank).alias("strategy"), F.col("_t").alias("target")).alias("_b"))
        found = hit if found is None else found.unionByName(hit)
    best = found.groupBy(ask_id).agg(F.min("_b").alias("_b"))
    return asked.select(ask_id).join(best, ask_id, "left").select(ask_id, F.coalesce("_b.strategy", F.lit(-1)).alias("strategy"), F.col("_b.target").alias("target"))


def path_violations(expected: DataFrame, actual: DataFrame, key: str, wanted: str, seen: str) -> DataFrame:
    """Constraints whose key has known decisions, none of which is the wanted one: key, wanted, n_known. Null decisions are unknown."""
    per = actual.where(F.col(seen).isNotNull()).join(expected.select(key, wanted), key).groupBy(key, wanted).agg(
        F.bool_or(F.col(seen) == F.col(wanted)).alias("_met"), F.count("*").alias("n_known")
    )
    return per.where("NOT _met").drop("_met")


def tightest_range(points: DataFrame, ranges: DataFrame, point_id: str, at: str, low: str, high: str, name: str) -> DataFrame:
    """The narrowest range that holds a point, first name on ties: point_id, name, span. Positions are whole numbers.

    A range lies in at most two blocks of the least power of two above its span, and a point looks into one block of every
    power that occurs (64 at most). So a wide range is never spread over narrow blocks, and a point meets few ranges of a
    power that don't hold it."""
    span = (F.col(high) - F.col(low)).cast("long")
    power = F.length(F.bin(span))
    spread = ranges.where(span >= 0).withColumns({"_w": power, "_s": span}).withColumn("_width", F.expr("shiftleft(1L, _w)"))
    block = lambda c: F.floor(F.col(c) / F.col("_width"))
    spread = spread.withColumn("_b", F.explode(F.array_distinct(F.array(block(low), block(high)))))
    powers = [r["_w"] for r in ranges.where(span >= 0).select(power.alias("_w")).distinct().collect()]
    levels = F.explode(F.array(*[F.lit(w) for w in powers]).cast("array<int>"))
    asked = points.select(point_id, F.col(at).alias("_at"), levels.alias("_w")).withColumn("_width", F.expr("shiftleft(1L, _w)")).withColumn("_b", block("_at"))
    held = asked.join(spread.select("_w", "_b", "_s", low, high, F.col(name).alias("_name")), ["_w", "_b"]).where(F.col("_at").between(F.col(low), F.col(high)))
    return held.groupBy(point_id).agg(F.min(F.struct("_s", "_name")).alias("_m")).select(point_id, F.col("_m._name").alias(name), F.col("_m._s").alias("span"))


def interval_conflicts(values: DataFrame, key: str, dimension: str, low: Column, high: Column) -> DataFrame:
    """Pairs of a key's dimensions whose intervals are disjoint: key, first, second (first < second), gap."""
    spans = values.groupBy(key, F.col(dimension).alias("d")).agg(F.min(low).alias("low"), F.max(high).alias("high"))
    a = spans.select(key, F.col("d").alias("first"), F.col("low").alias("_l1"), F.col("high").alias("_h1"))
    b = spans.select(key, F.col("d").alias("second"), F.col("low").alias("_l2"), F.col("high").alias("_h2"))
    gap = F.greatest(F.col("_l1"), F.col("_l2")) - F.least(F.col("_h1"), F.col("_h2"))
    return a.join(b, key).where((F.col("first") < F.col("second")) & (gap > 0)).select(key, "first", "second", F.round(gap, 4).alias("gap"))


def segment_conflicts(states: DataFrame, key: str, segment: str, variable: str, value: str) -> DataFrame:
    """Pairs of segments of a key that fix a variable to different values: key, variable, first_segment, second_segment (first < second)."""
    side = lambda n, v: states.where(F.col(value).isNotNull()).select(key, variable, F.col(segment).alias(n), F.col(value).alias(v))
    pairs = side("first_segment", "_v").join(side("second_segment", "_w"), [key, variable])
    return pairs.where((F.col("first_segment") < F.col("second_segment")) & (F.col("_v") != F.col("_w"))).select(key, variable, "first_segment", "second_segment")


def seed_union(phases: Sequence[DataFrame], keys: Sequence[str], reason: str) -> DataFrame:
    """Union of seed phases; of equal keys the reason of the earliest phase stays: keys, reason, phase."""
    tagged = None
    for i, phase in enumerate(phases):
        part = phase.select(*keys, F.struct(F.lit(i).alias("phase"), F.col(reason).alias("reason")).alias("_b"))
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.groupBy(*keys).agg(F.min("_b").alias("_b")).select(*keys, F.col("_b.reason").alias("reason"), F.col("_b.phase").alias("phase"))


def unique_match(asked: DataFrame, known: DataFrame, name: str, target: str) -> DataFrame:
    """Names with exactly one known target are resolved to it ('syntactic'); names with several stay unresolved ('candidate')."""
    index = known.groupBy(name).agg(F.count_distinct(target).alias("_n"), F.min(target).alias("_t"))
    joined = asked.join(index, name, "left")
    return joined.select(*asked.columns, F.when(F.col("_n") == 1, F.col("_t")).alias("target"), F.when(F.col("_n") == 1, "syntactic").when(F.col("_n") > 1, "candidate").otherwise("unresolved").alias("confidence"))


def suffix_pairs(asked: DataFrame, known: DataFrame, ask: str, know: str) -> DataFrame:
    """Pairs (ask, know) of distinct texts where the known one ends with the asked one, which isn't empty.

    Each known text stands under one hash for each length of its end, folded from the last character on, so the join grows
    with the texts' lengths; only ends as long as some asked text are kept, and texts decide behind the hash."""
    ends = lambda c: F.aggregate(F.reverse(F.split(c, "")), F.array(F.lit(42).cast("long")), lambda held, x: F.concat(held, F.array(F.xxhash64(x, F.element_at(held, -1)))))
    wanted = asked.select(ask).where(F.col(ask) != "").distinct().select(ask, F.length(ask).alias("_n"), F.element_at(ends(F.col(ask)), -1).alias("_h"))
    texts = known.select(know).where(F.col(know) != "").distinct()
    cut = texts.select(know, F.posexplode(ends(F.col(know))).alias("_n", "_h")).where("_n > 0").join(F.broadcast(wanted.agg(F.max("_n").alias("_most"))), F.col("_n") <= F.col("_most")).drop("_most")
    return wanted.join(cut, ["_n", "_h"]).where(F.endswith(know, F.col(ask))).select(ask, know)


def call_nodes(asked: DataFrame, nodes: DataFrame, tolerance: int = 5) -> DataFrame:
    """The call-graph node that each asked function stands for: ask, strategy, node.

    asked: ask, name, file, line; nodes: id, file, line, ordinal. Strategies: exact (the qualified name), place (the node's
    file ends with the asked one, lines at most so far apart), suffix (the name after ::), unresolved. The node of least
    ordinal is taken within a strategy; an empty or null file has no place."""
    first = F.min(F.struct("ordinal", "id")).alias("_b")
    exact = nodes.groupBy(F.col("id").alias("name")).agg(first)
    parts = F.split("id", "::")
    tails = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "::"))))
    suffix = nodes.select("ordinal", "id", tails.alias("name")).groupBy("name").agg(first)
    there = nodes.groupBy(F.col("file").alias("_file"), F.col("line").alias("_line")).agg(first)
    places = asked.where("file <> '' AND line IS NOT NULL").select("file", "line").distinct().join(suffix_pairs(asked, there, "file", "_file"), "file")
    place = band_join(places, there, "line", "_line", tolerance, ["_file"]).groupBy("file", "line").agg(F.min("_b").alias("_b"))
    found = asked.join(exact.withColumnRenamed("_b", "_exact"), "name", "left").join(place.withColumnRenamed("_b", "_place"), ["file", "line"], "left").join(suffix.withColumnRenamed("_b", "_suffix"), "name", "left")
    strategy = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_place").isNotNull(), "place").when(F.col("_suffix").isNotNull(), "suffix").otherwise("unresolved")
    return found.select("ask", strategy.alias("strategy"), F.coalesce("_exact", "_place", "_suffix")["id"].alias("node"))


def linked_calls(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """The graph node of every call site: its columns, node, synthesized.

    calls: function, line, callee; nodes: function, line, ordinal, id. Of the nodes on the call's line the last one is
    taken; where there is none, a node is made whose id is a hash of the site."""
    last = nodes.groupBy("function", "line").agg(F.max(F.struct("ordinal", "id"))["id"].alias("node"))
    made = F.concat(F.lit("call-"), F.substring(F.sha1(F.concat_ws("|", "function", F.col("line").cast("string"), "callee")), 1, 12))
    return calls.join(last, ["function", "line"], "left").select(*calls.columns, F.coalesce("node", made).alias("node"), F.col("node").isNull().alias("synthesized"))
