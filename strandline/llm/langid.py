"""Language identification: sparse multinomial logistic regression on TF-IDF weights of character n-grams.

A text becomes its letters in lower case, every other stretch one space; its one-, two- and three-grams are hashed into
BUCKETS features. Document frequencies are counted over all texts that may be learnt from. The regression is fitted by the
follow-the-regularised-leader rule (FTRL-proximal), whose L1 part leaves most weights exactly zero and whose L2 part
shrinks the others; a temperature fitted on texts left out of it then calibrates the probabilities.

It is fitted in one task on at most TRAIN_ROWS distinct texts of each language, picked by a hash of the text; nothing but
the model (BUCKETS rows at most, one weight a language) and document frequencies (BUCKETS numbers) comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm._store import materialize

#: Distinct texts of each language that the regression and its temperature are fitted on, and the share of the latter.
TRAIN_ROWS = 1_500
CALIBRATION_SHARE = 0.2
#: Features; the last one is the intercept.
BUCKETS = 1 << 18
#: More languages than this are an error: lang isn't a language column then.
MOST_LANGUAGES = 1_000
#: The prediction for a text without a letter.
UNDETERMINED = "und"
EPOCHS = 4
_SPACE = 32
_MIX = np.uint64(0x9E3779B97F4A7C15)
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """For every code point its lower case if it is a letter, else a space; built once a process."""
    if not _letters:
        table = np.full(0x110000, _SPACE, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                table[c] = ord(ch.lower()[0])
        _letters.append(table)
    return _letters[0]


def grams(text: str) -> np.ndarray:
    """The features of all one-, two- and three-grams of a text, repeats included; none if it has no letter."""
    codes = _letter_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    codes = np.concatenate([[_SPACE], codes, [_SPACE]]).astype(np.uint64)
    codes = codes[np.concatenate([[True], (codes[1:] != _SPACE) | (codes[:-1] != _SPACE)])]
    if len(codes) < 2:
        return np.empty(0, np.int64)
    two = (codes[:-1] << np.uint64(21)) | codes[1:] | np.uint64(1 << 62)
    three = (codes[:-2] << np.uint64(42)) | (codes[1:-1] << np.uint64(21)) | codes[2:]
    whole = np.concatenate([codes[1:-1], two, three]) * _MIX
    return ((whole ^ (whole >> np.uint64(29))) * _MIX >> np.uint64(32)).astype(np.int64) % (BUCKETS - 1)


class Counter:
    """Distinct features and their counts, with one scratch table a process instead of a sort a text."""

    def __init__(self) -> None:
        self.mark = np.zeros(BUCKETS, np.int64)

    def __call__(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.arange(len(found))
        self.mark[found] = order
        distinct = found[self.mark[found] == order]
        self.mark[distinct] = np.arange(len(distinct))
        return distinct, np.bincount(self.mark[found], minlength=len(distinct))


def vector(found: np.ndarray, idf: np.ndarray, count: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Features and TF-IDF weights of unit length, the intercept beside them."""
    distinct, n = count(found)
    weights = n * idf[distinct]
    norm = np.sqrt((weights * weights).sum())
    return np.append(distinct, BUCKETS - 1), np.append(weights / norm if norm else weights, 1.0)


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Ftrl:
    """FTRL-proximal for a table of features and classes: alpha and beta rule the steps, l1 and l2 are the elastic net."""

    features: int
    classes: int
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02
    z: np.ndarray = field(init=False)
    n: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.z, self.n = np.zeros((self.features, self.classes)), np.zeros((self.features, self.classes))

    def weights(self, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, rows: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(rows)
        slope = softmax(values @ w)
        slope[label] -= 1.0
        g = values[:, None] * slope
        n = self.n[rows]
        grown = n + g * g
        self.z[rows] += g - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
        self.n[rows] = grown


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden section on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        return -np.log(np.maximum(softmax(scores / np.exp(log_t))[np.arange(len(labels)), labels], 1e-300)).mean()

    low, high, ratio = -4.0, 4.0, (5**0.5 - 1) / 2
    while high - low > 1e-4:
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """Features with a weight, their weights, and the temperature; the last CALIBRATION_SHARE of rows is kept for the latter."""
    held = len(rows) - int(len(rows) * CALIBRATION_SHARE)
    known = np.unique(np.concatenate([r[0] for r in rows])) if rows else np.empty(0, np.int64)
    model, rng = Ftrl(len(known), classes), np.random.default_rng(13)
    at = [np.searchsorted(known, r[0]) for r in rows]
    for _ in range(epochs):
        for i in rng.permutation(held):
            model.learn(at[i], rows[i][1], rows[i][2])
    w = model.weights()
    scores = np.array([rows[i][1] @ w[at[i]] for i in range(held, len(rows))]).reshape(-1, classes)
    t = temperature(scores, np.array([r[2] for r in rows[held:]], np.int64))
    used = np.flatnonzero(np.abs(w).sum(axis=1))
    return known[used], w[used], t


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0


def held_out(id_col: str = "doc_id") -> Column:
    """Whether the CRC-32 of the id as text leaves 1 when divided by 3; a null id counts as empty and isn't held out."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count, total = Counter(), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for text in batch.column(0):
            total[count(grams(text.as_py()))[0]] += 1
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """Of every feature, the number of texts that have it."""
    per = texts.mapInArrow(_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(BUCKETS, np.int64)
    total[per["bucket"].to_numpy()] = per["n"].to_numpy()
    return total


def _fitter(languages: list[str], idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, number, rows = Counter(), {name: i for i, name in enumerate(languages)}, []
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                features, values = vector(grams(text.as_py()), idf, count)
                rows.append((features, values, number[lang.as_py()]))
        features, weights, t = fit(rows, len(languages))
        flat = pa.FixedSizeListArray.from_arrays(pa.array(weights.ravel()), len(languages)).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(features), flat], names=["bucket", "weights"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([[t]], pa.list_(pa.float64()))], names=["bucket", "weights"])

    return run


def _sample(learnt: DataFrame, sizes: dict[str, int], rows: int) -> DataFrame:
    """lang, text of at most so many distinct texts of each language, those of least hash."""
    span = 1 << 30
    rates = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(int(span * min(1.0, 1.5 * rows / max(n, 1) + 0.001))))])
    some = learnt.withColumn("h", F.xxhash64("text")).where(F.pmod(F.col("h"), F.lit(span)) < rates[F.col("lang")])
    once = some.groupBy("lang", "h").agg(F.first("text").alias("text"))
    best = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod(F.col("h"), F.lit(span)), "h"))
    return once.withColumn("_r", best).where(F.col("_r") <= rows).select("lang", "text", "h")


def train(df: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """The model learnt from texts that have a letter and a language and aren't held out; None if there are none."""
    learnt = df.where(~held_out(id_col)).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = learnt.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64("text")).alias("d")).limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"{lang_col} has more than {MOST_LANGUAGES} values")
    if not counts:
        return None
    languages = sorted(r["lang"] for r in counts)
    idf = np.log((1 + sum(r["n"] for r in counts)) / (1 + document_frequencies(learnt.select("text")))) + 1
    sample = materialize(_sample(learnt, {r["lang"]: r["d"] for r in counts}, rows), "language-sample")
    found = sample.repartition(1).sortWithinPartitions("h", "lang").select("lang", "text").mapInArrow(_fitter(languages, idf), "bucket long, weights array<double>").collect()
    weights, t = np.zeros((BUCKETS, len(languages)), np.float32), 1.0
    for r in found:
        if r["bucket"] < 0:
            t = r["weights"][0]
        else:
            weights[r["bucket"]] = r["weights"]
    return Model(languages, idf, weights, t)


def _predictor(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter()
        for batch in batches:
            names, scores = [], []
            for text in batch.column(1):
                t = text.as_py()
                found = grams(t) if t and model else ()
                if not len(found):
                    names.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                features, values = vector(found, model.idf, count)
                p = softmax(values @ model.weights[features] / model.temperature)
                best = int(p.argmax())
                names.append(model.languages[best])
                scores.append(float(p[best]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])

    return run


def predict(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: the id, held_out, lang_pred and score, the calibrated probability of the predicted language.

    A text that is null or has no letter is `und` with score 0, as is every text if there was nothing to learn from. Equal
    probabilities go to the first language in code-point order. Whole texts are read; repeated rows come out each, an empty
    table gives an empty one, other columns are left out."""
    kind = df.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    asked = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return asked.mapInArrow(_predictor(model), schema).select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "lang_pred", "score")
