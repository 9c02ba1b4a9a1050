"""Mixing of sources to target weights by iterative proportional fitting.

Tokens are counted per cell (source, language, topic). Raking scales the cells
in turn so that the weights of all sources, then of all languages, then of all
topics meet their targets, until all do; a cell's ratio of raked to
observed tokens is its calibration. A document is drawn with the probability
min(1, c * ratio), c being such that the expected tokens are the wanted
fraction of all; the draw is a hash of seed, id and text, so it is the same
whenever it is made.

All of it is DataFrame work: the corpus is aggregated once to the cells, the
raking runs on the cell table wherever it lies, and the documents get their
probability by a join on the cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm._store import fresh_name, materialize, text_or_empty

MARGINS = ("source", "lang", "topic")
#: Raking ends when no margin is farther from its target than this share, or when a block of rounds gets no nearer.
TOLERANCE = 1e-7
# Code points of scripts without spaces between words (Thai, Lao, Myanmar, Khmer, Kana, Han).
UNSPACED = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3041-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}"
#: Rounds in one plan; the cell table is written between such blocks.
ROUNDS_PER_PLAN = 4
#: A margin without given targets gets its observed shares to this power: below 1, small parts gain weight.
TEMPERATURE = {"source": 0.5, "lang": 0.7, "topic": 1.0}
#: The share of all tokens that the sample holds in expectation.
FRACTION = 0.6
#: Cells that are raked in one task and sent to every task; more stay spread out and are joined by shuffle.
BROADCAST_CELLS = 50_000


def topic_of(text: Column) -> Column:
    """The kind of writing by its form, at any length: symbols, table, list (a line end for every 60 characters or more) or prose."""
    n = F.length(text)
    without = n - F.length(F.translate(text, "#$%&*{}<>=\\", ""))
    bars = n - F.length(F.replace(text, F.lit(" | "), F.lit("")))
    ends = n - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(without * 20 > n, "symbols").when(bars * 20 > n, "table").when(ends * 60 > n, "list").otherwise("prose")


def tokens_of(text: Column) -> Column:
    """Characters of the scripts that set no space between words, and runs of anything else but white space."""
    marks = F.regexp_replace(text, rf"[^\x20\x09-\x0D{UNSPACED}]+|[{UNSPACED}]", "x")
    return F.length(F.translate(marks, " \t\n\x0b\x0c\r", "")).cast("long")


def _shares(cells: DataFrame, margin: str, targets: dict[str, float] | None, power: float) -> Column:
    """The target share of a cell's value in a margin, among the values that occur."""
    if targets is not None:
        # values without a target keep their observed share; targets are scaled to sum to 1 with these
        listed = F.coalesce(*[F.when(F.col(margin).eqNullSafe(k), F.lit(float(v))) for k, v in targets.items()], F.col(f"_{margin}") / F.col("_all"))
    else:
        listed = F.pow(F.col(f"_{margin}") / F.col("_all"), power)
    return listed


def _together(cells: DataFrame, few: bool) -> DataFrame:
    """Few cells lie in one partition, where every margin's window finds its rows without an exchange."""
    return cells.coalesce(1) if few else cells


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """cells has the MARGINS and tokens (positive); adds weight, the raked share of all tokens, and ratio to the observed one."""
    targets = targets or {}
    total, n_cells = cells.agg(F.sum("tokens"), F.count("*")).first()
    total, few = total or 0, n_cells <= BROADCAST_CELLS
    now = _together(cells, few).withColumn("_all", F.lit(float(total))).withColumn("weight", F.col("tokens") / F.col("_all"))
    for m in MARGINS:
        now = now.withColumn(f"_{m}", F.sum("tokens").over(Window.partitionBy(m)).cast("double"))
        now = now.withColumn(f"_t_{m}", _shares(now, m, targets.get(m), TEMPERATURE[m]))
    now = materialize(now, "cells")
    norms = {}
    for m in MARGINS:
        norms[m] = now.groupBy(m).agg(F.first(f"_t_{m}").alias("t")).agg(F.sum("t")).first()[0] or 1.0
    now = _together(now, few).withColumns({f"_t_{m}": F.col(f"_t_{m}") / F.lit(norms[m]) for m in MARGINS})
    before = None
    while True:
        for _ in range(ROUNDS_PER_PLAN):
            for m in MARGINS:
                now = now.withColumn("weight", F.col("weight") * F.col(f"_t_{m}") / F.sum("weight").over(Window.partitionBy(m)))
        now = _together(materialize(now, "cells"), few)
        left = residual(now)
        if left <= TOLERANCE or (before is not None and left > 0.5 * before):  # targets that contradict each other are met as near as rounds come
            return now.select(*MARGINS, "tokens", "weight", (F.col("weight") * F.col("_all") / F.col("tokens")).alias("ratio"))
        before = left


def residual(weighted: DataFrame) -> float:
    """The largest gap between a margin value's weight and its target; weighted has the MARGINS, weight and each target as _t_ and its margin."""
    gaps = [weighted.groupBy(m).agg(F.abs(F.sum("weight") - F.first(f"_t_{m}")).alias("gap")).agg(F.max("gap")).first()[0] for m in MARGINS]
    return max(g or 0.0 for g in gaps)


def calibrate(raked: DataFrame, fraction: float) -> DataFrame:
    """Adds probability = min(1, c * ratio), with c such that the expected tokens are the fraction of all (all, if that takes more than everything).

    Cells that reach 1 hold their tokens, the others share what is left; c grows with each round until no further cell
    reaches 1. A round is one aggregation over the cells, wherever they lie."""
    mass = F.col("ratio") * F.col("tokens")
    total, every = raked.agg(F.sum("tokens"), F.sum(mass)).first()
    wanted, c = float(fraction) * float(total or 0), 0.0
    if every:
        c, new = -1.0, wanted / every
        while new > c * (1 + 1e-12):
            c = new
            held, free = raked.agg(F.sum(F.when(F.col("ratio") * c >= 1, F.col("tokens"))), F.sum(F.when(F.col("ratio") * c < 1, mass))).first()
            if not free:
                c = float("inf")
                break
            new = (wanted - float(held or 0)) / free
    p = F.lit(1.0) if c == float("inf") else F.least(F.lit(1.0), F.col("ratio") * c)
    return raked.select(*MARGINS, "tokens", "weight", "ratio", p.alias("probability"))


def draw(seed: int, *columns: Column) -> Column:
    """A number in [0, 1) that seed and columns fix."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) / F.lit(float(1 << 53))


def _described(df: DataFrame, text_col: str) -> dict[str, Column]:
    text = text_or_empty(text_col)
    return {"_source": F.coalesce(F.col("source").cast("string"), F.lit("")), "_lang": F.coalesce(F.col("lang").cast("string"), F.lit("")), "_topic": topic_of(text), "_tokens": tokens_of(text)}


def _probabilities(df: DataFrame, targets, fraction: float, text_col: str) -> DataFrame:
    described = df.select(*[c.alias(n) for n, c in _described(df, text_col).items()])
    cells = described.groupBy(F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic")).agg(F.sum("_tokens").alias("tokens"))
    cells = materialize(cells.where("tokens > 0"), "cells")
    found = materialize(calibrate(rake(cells, targets), fraction), "probabilities")
    found = found.select(*[F.col(m).alias(f"_{m}") for m in MARGINS], "weight", "ratio", "probability")
    return F.broadcast(found) if found.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS else found.hint("merge")


def mix(df: DataFrame, targets: dict[str, dict[str, float]] | None = None, fraction: float = FRACTION, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: the id, source, lang, topic, tokens, weight, ratio, probability, sampled.

    Null source and language count as the empty string, a null text as empty. Empty texts have no tokens and no part in
    the targets; a cell of nothing else has probability 1. Repeated rows share their draw. An empty table gives an empty one."""
    found = _probabilities(df, targets, fraction, text_col)
    keys = [f"_{m}" for m in MARGINS]
    rows = df.select(F.col(id_col).alias("_id"), *[c.alias(n) for n, c in _described(df, text_col).items()], F.crc32(text_or_empty(text_col).cast("binary")).alias("_crc"))
    joined = rows.join(found, keys, "left")
    p = F.coalesce(F.col("probability"), F.lit(1.0))
    return joined.select(
        F.col("_id").alias(id_col), F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), F.col("_tokens").alias("tokens"),
        F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("ratio", F.lit(1.0)).alias("ratio"), p.alias("probability"), (draw(seed, F.col("_id"), F.col("_crc")) < p).alias("sampled"),
    )


def sample_mixture(df: DataFrame, targets: dict[str, dict[str, float]] | None = None, fraction: float = FRACTION, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that mix samples, with df's columns."""
    names = {f"_{m}": fresh_name(df, f"mix_{m}") for m in MARGINS} | {"probability": fresh_name(df, "mix_probability")}
    found = _probabilities(df, targets, fraction, text_col).select(*[F.col(k).alias(v) for k, v in names.items()])
    described = {names[n]: c for n, c in _described(df, text_col).items() if n in names}
    joined = df.withColumns(described).join(found, [names[f"_{m}"] for m in MARGINS], "left")
    drawn = draw(seed, F.col(id_col), F.crc32(text_or_empty(text_col).cast("binary"))) < F.coalesce(F.col(names["probability"]), F.lit(1.0))
    return joined.where(drawn).select(*[F.col(f"`{c}`") for c in df.columns])
