"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Fitted with follow-the-regularised-leader and elastic-net penalties on a
bounded sample of labelled rows (``per_lang`` of each language); a temperature
is then fitted on a part of the sample that the weights have not seen. The
n-grams (1 to 3 code points, lower case, runs of white space as one blank) are
hashed to ``DIMS`` columns; a text's row is (1 + log tf) * idf, of unit length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import crc32_mod, share, slices
from quarryline.llm.sampling import bounded_sample, collected

DIMS = 1 << 16
UND = "und"
_SPACE = re.compile(r"\s+")


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def gram_counts(text: str, step: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Columns and counts of the n-grams of a whole text, ``step`` code points at a time."""
    points = np.frombuffer((" " + _SPACE.sub(" ", text.lower()) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(points) <= min(step, DIMS // 32):  # few columns: sorted; else all of them are counted through
        return np.unique(np.concatenate(list(_columns(points, step))), return_counts=True)
    total = np.zeros(DIMS, np.int64)
    for at in range(0, len(points), step):
        for columns in _columns(points[at : at + step + 2], step):
            total += np.bincount(columns, minlength=DIMS)
    at = np.flatnonzero(total)
    return at, total[at]


def _columns(points: np.ndarray, step: int) -> Iterator[np.ndarray]:
    """Columns of the runs of one, two and three code points that start in the first ``step``."""
    value = np.zeros(len(points), np.uint64)
    for n in range(1, 4):
        m = min(step, len(points) - n + 1)
        if m <= 0:
            break
        value = (value[: len(points) - n + 1] + points[n - 1 :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
        yield ((value[:m] * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)).astype(np.int64)


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # languages x columns, single precision
    bias: np.ndarray
    temperature: float = 1.0

    def row(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        at, tf = gram_counts(text)
        x = (1 + np.log(tf)) * self.idf[at]
        return at, x / (np.sqrt((x * x).sum()) or 1.0)

    def logits(self, text: str) -> np.ndarray:
        at, x = self.row(text)
        return self.weights[:, at] @ x + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return UND, 0.0
        p = _softmax(self.logits(text) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 3, seed: int = 0) -> np.ndarray:
    """Weights ``classes x (DIMS + 1)``, the last column the bias; zero where |z| <= l1."""
    z, n = np.zeros((classes, DIMS + 1)), np.zeros((classes, DIMS + 1))
    rng = np.random.default_rng(seed)

    def weights(at):
        zs = z[:, at]
        w = -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(n[:, at])) / alpha + l2)
        w[np.abs(zs) <= l1] = 0
        return w

    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = np.append(rows[i][0], DIMS), np.append(rows[i][1], 1.0)
            w = weights(at)
            p = _softmax(w @ x)
            p[labels[i]] -= 1
            g = p[:, None] * x
            sigma = (np.sqrt(n[:, at] + g * g) - np.sqrt(n[:, at])) / alpha
            z[:, at] += g - sigma * w
            n[:, at] += g * g
    return weights(np.arange(DIMS + 1))


def calibrate(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden-section search over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        s = logits / np.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(labels)), labels]).mean())

    lo, hi, phi = np.log(0.02), np.log(50.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - phi * (hi - lo), lo + phi * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fit(rows: list[tuple[str, str]], seed: int = 0) -> Model:
    """From ``(text, lang)`` rows; every fifth is kept for the temperature. Without rows: a model that says ``und``."""
    rows = [(t, lang) for t, lang in rows if has_letter(t)]
    langs = sorted({lang for _, lang in rows})
    model = Model(langs, np.ones(DIMS), np.zeros((len(langs), DIMS), np.float32), np.zeros(len(langs)))
    if not rows:
        return model
    order = np.random.default_rng(seed).permutation(len(rows))
    kept, train = order[::5] if len(rows) >= 50 else order[:0], order if len(rows) < 50 else np.setdiff1d(order, order[::5])
    df = np.zeros(DIMS)
    for i in train:
        df[gram_counts(rows[i][0])[0]] += 1
    model.idf = np.log((1 + len(train)) / (1 + df)) + 1
    y = np.array([langs.index(lang) for _, lang in rows])
    w = ftrl([model.row(rows[i][0]) for i in train], y[train], len(langs), seed=seed)
    model.weights, model.bias = w[:, :DIMS].astype(np.float32), w[:, DIMS]
    model.temperature = calibrate(np.array([model.logits(rows[i][0]) for i in kept]).reshape(len(kept), -1), y[kept])
    return model


def train(docs: DataFrame, per_lang: int = 1000, seed: int = 0, most_langs: int = 256) -> Model:
    """A model from ``docs(doc_id, text, lang)``, of at most about ``per_lang`` rows a language.

    Rows with a null text, lang or doc_id teach nothing. Only the ``most_langs``
    languages of most rows are learned, and ``sampling.MOST_ROWS`` rows in all,
    which bounds sample and weights where the column holds anything. Of a
    doc_id's rows in one language the smallest text teaches.
    """
    rows = docs.where("doc_id is not null and text is not null and lang is not null")
    named = rows.groupBy("doc_id", "lang").count().drop("count")
    return fit(collected(rows.select("doc_id", "text"), bounded_sample(named, "lang", per_lang, seed, most_langs), "lang"), seed)


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared()
        for part in slices(batches):
            out = [model.predict(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` for each row of ``docs(doc_id, text)``; a narrow operation.

    Null text or text without a letter: ``und`` with score 0. Of languages of
    equal probability the first by name is given. Null doc_ids and
    repeated rows are returned as they are. Empty table: no rows.
    """
    shared = share(docs.sparkSession, model)  # languages x DIMS single-precision numbers
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double")


def held_out(df: DataFrame, folds: int = 5) -> DataFrame:
    return df.withColumn("held_out", F.coalesce(crc32_mod(F.col("doc_id"), folds) == 0, F.lit(False)))
