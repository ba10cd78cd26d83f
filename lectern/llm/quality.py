"""Quality classifier: Bradley-Terry ranking of documents by features of their text.

Pairs of a better and a worse labelled document are preferences; logistic loss
on the difference of their features fits one weight for each feature, so a
document has a latent score. The threshold is the quantile of the learning
scores that leaves as many documents above it as are labelled good, and the
reported score is the logistic function of the distance to it.

Defined results: null text is empty; empty texts have the features of nothing
and a score like any other; labels that are null are not learned from; with
fewer than one document of either label every score is 0.5; of a document's
repeated or conflicting labels each counts; repeated rows are scored each; an
empty table returns no rows. Only doc_id and text are read of documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.storage import hash_sample

_CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "space": b" \t\r\x0b\x0c",
    "line": b"\n",
    "stop": b".?",
    "pause": b",;:",
    "quote": b"'\"()-",
    "bang": b"!",
    "bar": b"|",
    "markup": b"<>{}[]\\/=_~^`",
    "symbol": b"#$%&*+@",
}
_CLASS = np.full(256, len(_CLASSES), dtype=np.int64)
for _i, _chars in enumerate(_CLASSES.values()):
    _CLASS[list(_chars)] = _i
_CLASS[128:] = len(_CLASSES) + 1
_KINDS = len(_CLASSES) + 2
FEATURES = (*(f"share_{k}" for k in _CLASSES), "share_control", "share_wide", "log_words", "word_length", "stops_a_word", "pauses_a_word", "capitals_a_word", "distinct_words", "repeated_lines", "words_a_line", "symbols_a_word")


def features(text: str) -> np.ndarray:
    """Shares of character classes, and shapes of words and lines, of a whole text."""
    data = text.encode()
    count = np.bincount(_CLASS[np.frombuffer(data, dtype=np.uint8)], minlength=_KINDS).astype(float)
    named = dict(zip(_CLASSES, count, strict=False))
    total = max(1.0, count.sum())
    words = data.split()
    n = max(1, len(words))
    lines = [x for x in data.split(b"\n") if x]
    letters = max(1.0, named["lower"] + named["upper"])
    return np.concatenate(
        (
            count / total,
            [
                np.log1p(len(words)),
                min(40.0, (total - named["space"] - named["line"]) / n),
                min(3.0, named["stop"] / n),
                min(3.0, named["pause"] / n),
                named["upper"] / letters,
                len(set(words)) / n if words else 1.0,
                1.0 - len(set(lines)) / len(lines) if lines else 0.0,
                np.log1p(n / max(1, len(lines))),
                min(6.0, (named["symbol"] + named["bang"] + named["bar"]) / n),
            ],
        )
    )


@dataclass
class Ranker:
    """Weights on standardised features, and the threshold on the latent score."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def latent(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows - self.mean) / self.scale, -8, 8) @ self.weights

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.latent(rows) - self.threshold, -30, 30)))


def fit(rows: np.ndarray, labels: np.ndarray, pairs: int = 40_000, rounds: int = 60, ridge: float = 1e-3, seed: int = 7) -> Ranker:
    """Fit by Newton's method on ``pairs`` random preferences of a good over a bad document."""
    width = len(FEATURES)
    mean, scale = (rows.mean(axis=0), rows.std(axis=0) + 1e-6) if len(rows) else (np.zeros(width), np.ones(width))
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(good) or not len(bad):
        return Ranker(mean, scale, np.zeros(width), 0.0)
    rng = np.random.default_rng(seed)
    x = np.clip((rows - mean) / scale, -8, 8)
    difference = x[rng.choice(good, pairs)] - x[rng.choice(bad, pairs)]
    weights = np.zeros(width)
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(np.clip(difference @ weights, -30, 30)))  # probability of the wrong order
        gradient = -(difference * p[:, None]).mean(axis=0) + ridge * weights
        hessian = (difference * (p * (1 - p))[:, None]).T @ difference / pairs + ridge * np.eye(width)
        step = np.linalg.solve(hessian, gradient)
        weights -= step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-6:
            break
    latent = x @ weights
    # between the last score below and the first above the quantile of the bad share
    ranked, cut = np.sort(latent), len(bad)
    return Ranker(mean, scale, weights, float((ranked[cut - 1] + ranked[min(cut, len(ranked) - 1)]) / 2))


_FEATURE_ROW = "label int, features array<double>"


def train(docs: DataFrame, labels: DataFrame, learnable: Column, documents: int = 20_000) -> Ranker:
    """Learn from about ``documents`` labelled rows at most, taken by the hash of their id.

    ``learnable`` marks the rows of ``labels`` to learn from. The sample of ids
    is bounded, so joining it to the texts needs no shuffle of them; features
    are made on the executors.
    """
    own = labels.where(learnable).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    sample = hash_sample(own, documents, "doc_id")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.float64()))], ["label", "features"])

    # about `documents` ids of 12 bytes: a broadcast of a bounded size
    found = texts.join(F.broadcast(sample), "doc_id").select("label", "text").mapInArrow(run, _FEATURE_ROW).toPandas()
    rows = np.array(found["features"].tolist(), dtype=float).reshape(len(found), len(FEATURES))
    order = np.lexsort((*rows.T, found["label"].to_numpy()))  # the order of tasks must not matter
    return fit(rows[order], found["label"].to_numpy()[order])


SCORED = "doc_id long, score double, predicted int"


def score(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """One row per document: ``SCORED``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            value = ranker.scores(np.array([features(t or "") for t in batch.column(1).to_pylist()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value), pa.array((value >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCORED)
