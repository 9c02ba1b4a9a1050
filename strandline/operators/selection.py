"""One candidate for every segment of a report, without a conflict among them: conflict-directed search, report by report."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Selections that are tried in a report before it is given up as open.
MOST_TRIED = 100_000


def first_free_selection(candidates: list[list[str]], clashes: set[frozenset], most_tried: int = MOST_TRIED) -> tuple[list[int] | None, int, bool]:
    """(places of the first selection without a clash, selections tried, whether the search came to an end).

    candidates: of each segment, in order, its candidates from the best on; clashes: sets of (segment, candidate) that can't
    stand together. Segments are filled in order. Where no candidate of a segment fits, the search goes back to the last
    segment that had a part in it, past all that hadn't; the sets of choices found to lead nowhere are kept as further
    clashes, so nothing is found out twice. The first selection in the order of places comes out, as it would from trying all."""
    by_last: dict[tuple[int, str], list[frozenset]] = {}

    def learn(clash: frozenset) -> None:
        by_last.setdefault(max(clash), []).append(clash)

    for clash in clashes:
        learn(clash)
    n, tried = len(candidates), 0
    chosen: list[int] = []
    why: list[set[int]] = [set() for _ in range(n + 1)]
    at, place = 0, 0
    while True:
        if at == n:
            return chosen, tried, True
        found = False
        while place < len(candidates[at]):
            tried += 1
            if tried > most_tried:
                return None, tried, False
            now = {(k, candidates[k][c]) for k, c in enumerate(chosen)} | {(at, candidates[at][place])}
            hit = next((c for c in by_last.get((at, candidates[at][place]), ()) if c <= now), None)
            if hit is None:
                found = True
                break
            why[at] |= {k for k, _ in hit if k < at}
            place += 1
        if found:
            chosen.append(place)
            at, place = at + 1, 0
            why[at] = set()
            continue
        blamed = why[at]
        if not blamed:
            return None, tried, True
        back = max(blamed)
        if len(blamed) <= 3:  # short ones are met again, long ones hardly
            learn(frozenset((k, candidates[k][chosen[k]]) for k in blamed))
        place = chosen[back] + 1
        why[back] |= blamed - {back}
        del chosen[back:]
        at = back


def _selected(own: list[tuple], pairs: list[tuple], most_tried: int) -> Iterator[tuple]:
    """(verdict, segment, candidate, rank, tried) of one report from its (segment, rank, candidate) and its conflicts."""
    lists: dict = {}
    for segment, rank, candidate in sorted(own):
        lists.setdefault(segment, {}).setdefault(candidate, rank)
    number = {s: i for i, s in enumerate(lists)}
    clashes = {frozenset(((number[a], b), (number[c], d))) for a, b, c, d in pairs if b in lists.get(a, ()) and d in lists.get(c, ())}
    found, tried, ended = first_free_selection([list(c) for c in lists.values()], clashes, most_tried)
    if found is None:
        yield "infeasible" if ended else "open", None, None, None, tried
        return
    for (segment, ranks), place in zip(lists.items(), found):
        candidate = list(ranks)[place]
        yield "found", segment, candidate, ranks[candidate], tried


def select_segments(candidates: DataFrame, conflicts: DataFrame, most_tried: int = MOST_TRIED) -> DataFrame:
    """report, verdict, segment, candidate, rank, tried: a candidate for each segment, or why there are none.

    candidates: report, segment, candidate, rank; conflicts: report, segment, candidate, other_segment, other_candidate, the
    pairs that can't stand together (a pair with itself rules a candidate out). verdict is found (a row a segment),
    infeasible or open (one row with nulls each): no selection is free of conflicts, or most_tried ended the search. Of all
    free selections the first in the order of segments and ranks is taken; equal ranks go by candidate. Reports are
    searched apart from one another and hold their own candidates only; conflicts of unknown candidates don't matter."""

    kind = candidates.schema
    schema = ", ".join(["report " + kind["report"].dataType.simpleString(), "verdict string", "segment " + kind["segment"].dataType.simpleString(), "candidate string", "rank " + kind["rank"].dataType.simpleString(), "tried long"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, (own, pairs) in enumerate(zip(*[zip(*[c.to_pylist() for c in part]) for part in (batch.columns[1:4], batch.columns[4:])])):
                found = list(_selected(list(zip(*own)), list(zip(*[p or () for p in pairs])), most_tried))
                at.extend([i] * len(found))
                rows.extend(found)
            listed = list(zip(*rows)) or [()] * 5
            types = [pa.string(), batch.schema.field(1).type.value_type, pa.string(), batch.schema.field(2).type.value_type, pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(v, t) for v, t in zip(listed, types)]], names=["report", "verdict", "segment", "candidate", "rank", "tried"])

    text = lambda c: F.col(c).cast("string").alias(c)
    left = candidates.groupBy("report").agg(F.collect_list(F.struct("segment", "rank", text("candidate"))).alias("c"))
    right = conflicts.groupBy(F.col("report").alias("of")).agg(F.collect_list(F.struct("segment", text("candidate"), "other_segment", text("other_candidate"))).alias("p"))
    both = left.join(right, F.col("report").eqNullSafe(F.col("of")), "left")
    return both.select("report", "c.segment", "c.rank", "c.candidate", "p.segment", "p.candidate", "p.other_segment", "p.other_candidate").toDF("report", *"abcdefg").mapInArrow(search, schema)
