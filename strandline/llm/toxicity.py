"""Toxicity by cumulative-link ordinal regression on sparse text features.

Severity has three grades: 0 none, 1 mild, 2 severe. Labels only tell toxic
texts from others, so a toxic training text is severe if it holds more distinct
toxic features than the median toxic text. The model has one weight per
feature, shared by both thresholds: P(grade <= k) = sigmoid(threshold_k - x.w).
The expected severity is the mean grade.

Features are a text's words and word beginnings, each with how many distinct
tokens show it (one, two or four at least), as some abuse is a stem that clean
texts hold now and then. The model is fitted on at
most TRAIN_ROWS labelled texts of each class, picked by a hash of their ids;
the features are chosen by a chi-square test on that sample. What is
broadcast is the model: MAX_FEATURES weights at most.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from strandline.llm._store import materialize, released, text_or_empty

#: Labelled texts of each class that the model is fitted on.
TRAIN_ROWS = 4_000
MAX_FEATURES = 3_000
#: Training texts that a feature must be in, and the least chi-square of its table against the label.
MIN_TEXTS = 4
MIN_CHI2 = 20.0
STEM_LENGTHS = (3, 4, 5, 6, 7, 8)
#: A feature is told apart by the least of these numbers of distinct tokens that show it.
DOSES = (1, 2, 4)
GRADES = 3
_MEMO = 100_000
_LETTERS = re.compile(r"[^\W\d_]+")


def word_features(token: str) -> list[str]:
    """The features of a lower-case token between white space: its runs of letters, and their beginnings."""
    found = set()
    for w in _LETTERS.findall(token):
        found.add(w)
        found.update(f"{w[:n]}-" for n in STEM_LENGTHS if len(w) > n)
    return sorted(found)


def dosed(counts: Counter[str]) -> list[str]:
    return [f"{f}#{d}" for f, n in counts.items() for d in DOSES if n >= d]


def features(text: str) -> list[str]:
    """The features of a text with their doses, from its distinct tokens."""
    return dosed(Counter(f for t in set(text.lower().split()) for f in word_features(t)))


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = (20.0, 21.0)
    cut: float = 0.5

    def grades(self, score: np.ndarray) -> np.ndarray:
        """P(grade = 0), ..., P(grade = GRADES - 1) in columns."""
        upto = 1 / (1 + np.exp(-np.clip(np.asarray(self.thresholds)[None, :] - score[:, None], -500, 500)))
        upto = np.concatenate([upto, np.ones((len(score), 1))], axis=1)
        return np.diff(upto, axis=1, prepend=0.0)


def fit_ordinal(rows: list[list[int]], grades: np.ndarray, weights: np.ndarray, n_features: int, steps: int = 500, rate: float = 0.1, ridge: float = 2e-5) -> tuple[np.ndarray, np.ndarray]:
    """Feature weights and ordered thresholds of the cumulative-link model by full-batch Adam on the penalised likelihood."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.array([c for r in rows for c in r], np.int64)
    k = GRADES - 1
    p = np.concatenate([np.zeros(n_features), [1.0], np.zeros(k - 1)])  # weights, first threshold, logs of the steps between thresholds
    m, v = np.zeros_like(p), np.zeros_like(p)
    total = weights.sum()
    for step in range(1, steps + 1):
        w, gaps = p[:n_features], np.exp(p[n_features + 1 :])
        theta = p[n_features] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(at, w[col], len(rows)) if len(col) else np.zeros(len(rows))
        upto = 1 / (1 + np.exp(-np.clip(theta[None, :] - score[:, None], -40, 40)))
        full = np.concatenate([np.zeros((len(rows), 1)), upto, np.ones((len(rows), 1))], axis=1)
        slope = full * (1 - full)
        idx = np.arange(len(rows))
        prob = np.maximum(full[idx, grades + 1] - full[idx, grades], 1e-12)
        high, low = slope[idx, grades + 1] / prob * weights / total, slope[idx, grades] / prob * weights / total
        d_score = high - low  # of the loss: raising the score lowers both cumulative probabilities
        g = np.zeros_like(p)
        g[:n_features] = (np.bincount(col, d_score[at], n_features) if len(col) else 0) + ridge * w
        d_theta = np.zeros(k)
        for j in range(k):
            d_theta[j] = -(high[grades == j].sum() - low[grades == j + 1].sum())
        g[n_features] = d_theta.sum()
        for j in range(1, k):
            g[n_features + j] = d_theta[j:].sum() * gaps[j - 1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return p[:n_features], p[n_features] + np.concatenate([[0.0], np.cumsum(np.exp(p[n_features + 1 :]))])


def _sample(documents: DataFrame, labels: DataFrame, rows: int, id_col: str, text_col: str) -> DataFrame:
    """label and text of at most so many labelled documents of each class; ids in the order of their hash."""
    ids = labels.select(F.col(id_col).cast("long").alias("_id"), (F.col("toxic").cast("int") > 0).cast("int").alias("label")).where("_id is not null and label is not null")
    ids = ids.groupBy("_id").agg(F.max("label").alias("label"))
    order = [F.xxhash64("_id"), "_id"]
    chosen = ids.where("label = 1").orderBy(*order).limit(rows).unionByName(ids.where("label = 0").orderBy(*order).limit(rows))
    texts = documents.select(F.col(id_col).cast("long").alias("_id"), text_or_empty(text_col).alias("text"))
    return texts.join(F.broadcast(chosen), "_id").select("label", "text")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 64):  # a text has thousands of features: few texts at a time
            b = whole.slice(at, 64)
            sets = [sorted(features(t)) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["label"], b["print"], pa.array(sets, pa.list_(pa.string()))], names=["label", "print", "features"])


def train(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most so many labelled documents of each class; copies among them count once. Without labels of both classes nothing is toxic."""
    sample = _sample(documents, labels, rows, id_col, text_col)
    once = sample.groupBy(F.xxhash64("text").alias("print")).agg(F.max("label").alias("label"), F.first("text").alias("text"))
    counted = materialize(once.mapInArrow(released(_counted), "label int, print long, features array<string>"), "toxicity-sample")
    sizes = {r["label"]: r["n"] for r in counted.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Model()
    per = counted.select("label", F.explode("features").alias("feature")).groupBy("feature").agg(F.sum("label").alias("a"), F.count("*").alias("n")).where(F.col("n") >= MIN_TEXTS)
    a, b, n = F.col("a").cast("double"), (F.col("n") - F.col("a")).cast("double"), float(n0 + n1)
    c, d = F.lit(float(n1)) - a, F.lit(float(n0)) - b
    gap = F.greatest(F.abs(a * d - b * c) - n / 2, F.lit(0.0))
    chi2 = n * gap * gap / ((a + b) * (c + d) * n1 * n0)
    least = min(MIN_CHI2, 0.1 * min(n0, n1))  # small samples cannot reach more
    best = per.where((c + d > 0) & (chi2 >= least)).orderBy(chi2.desc(), "feature").limit(MAX_FEATURES)
    chosen = {r["feature"]: (r["a"], r["n"]) for r in best.collect()}
    index = {f: i for i, f in enumerate(sorted(chosen))}
    if not index:
        return Model()
    odds = {f: np.log((x + 0.5) / (n1 + 1)) - np.log((m - x + 0.5) / (n0 + 1)) for f, (x, m) in chosen.items()}
    known = F.broadcast(documents.sparkSession.createDataFrame(list(index.items()), "feature string, number int"))
    hits = counted.select("print", "label", F.explode_outer("features").alias("feature")).join(known, "feature", "left")
    kept = hits.groupBy("print", "label").agg(F.sort_array(F.collect_list("number")).alias("numbers"))
    seen = sorted(kept.toLocalIterator(), key=lambda r: r["print"])  # the sample is bounded by 2 * rows, its features by MAX_FEATURES
    marks, found = [r["label"] for r in seen], [r["numbers"] for r in seen]
    names = sorted(index)
    dose = np.array([sum(odds[names[i]] > 1 for i in f) for f in found])
    label = np.array(marks)
    grades = np.where(label == 0, 0, np.where(dose > np.median(dose[label == 1]), 2, 1))
    # classes weigh as they do among all labels
    share = labels.agg(F.avg((F.col("toxic").cast("int") > 0).cast("double"))).first()[0]
    weights = np.where(label == 1, share / n1, (1 - share) / n0)
    w, theta = fit_ordinal(found, grades, weights, len(index))
    return Model({f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-6}, tuple(float(t) for t in theta))


def _scorer(model: Model):
    weights = model.weights
    bare = {f.rsplit("#", 1)[0] for f in weights}
    memo: dict[str, tuple[str, ...]] = {}

    def score(text: str) -> float:
        if len(memo) > _MEMO:
            memo.clear()
        hits: Counter[str] = Counter()
        for token in set(text.lower().split()):
            if (known := memo.get(token)) is None:
                known = memo[token] = tuple(f for f in word_features(token) if f in bare)
            if known:
                hits.update(known)
        return sum(weights.get(f, 0.0) for f in sorted(dosed(hits))) if hits else 0.0

    return score


_RESULT = "struct<severity: double, grade: int, p_mild: double, p_severe: double, toxic: boolean>"


def _judge(model: Model):
    @pandas_udf(_RESULT)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from released(graded)(batches)

    def graded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        score = _scorer(model)
        for texts in batches:
            yield verdicts(np.array([score(t) for t in texts], float))

    def verdicts(scores: np.ndarray) -> pd.DataFrame:
        p = model.grades(scores)
        severity = p @ np.arange(GRADES)
        return pd.DataFrame({"severity": severity, "grade": p.argmax(axis=1).astype(np.int32), "p_mild": p[:, 1], "p_severe": p[:, 2], "toxic": (1 - p[:, 0] >= model.cut) & (scores > 0)})

    return judge


def grade_toxicity(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: the id, severity (expected grade, 0 to 2), grade, p_mild, p_severe, toxic.

    toxic: a grade above 0 is at least as likely as not, and the features speak for it. A null or empty text has none and
    is never toxic. Repeated rows come out each; an empty table gives an empty one; other columns of df are left out."""
    judged = df.select(F.col(id_col).alias("_id"), _judge(model)(text_or_empty(text_col)).alias("_j"))
    return judged.select(F.col("_id").alias(id_col), "_j.severity", "_j.grade", "_j.p_mild", "_j.p_severe", "_j.toxic")


def drop_toxic(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of df that the model doesn't find toxic, with df's columns."""
    return df.where(~_judge(model)(text_or_empty(text_col))["toxic"])
