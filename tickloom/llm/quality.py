"""Quality classifier: Naive Bayes support vectors.

A document is the set of its n-grams: byte 2- and 3-grams, and 1- to 3-grams of word
shapes (class of the first and last character, and whether the word repeats one of the
four before it).  Each indicator is scaled by the log ratio of its smoothed counts in
the two classes, and a linear hinge-loss model is fitted on the scaled indicators by
dual coordinate descent.  A held-back part of the sample turns margins into scores.

The fit uses at most ``cap`` labelled documents per class, chosen by hash (a parameter);
scores read every whole text.

Cases: null and empty texts have no n-grams and score by the model's offset; labels that
are null or of unknown documents are not used; a document labelled twice counts twice;
without both classes among the labels every score is 0.5; an empty table gives no rows;
columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType

from .common import crc_fold, text_or_empty
from .fitting import spread, with_features

PAIR_SIZE, TRIPLE_BITS, SHAPE_BITS = 1 << 16, 17, 15
SIZE = PAIR_SIZE + (1 << TRIPLE_BITS) + (1 << SHAPE_BITS)
BLOCK = 1 << 20  # bytes or words turned into n-grams at once


def _classes() -> np.ndarray:
    """Class of a byte: capital, small or part of a longer character, digit, sentence mark, other."""
    kind = np.full(256, 4, dtype=np.uint32)
    kind[[ord(c) for c in ".,;:?!"]] = 3
    kind[ord("0") : ord("9") + 1] = 2
    kind[ord("a") : ord("z") + 1] = 1
    kind[128:] = 1
    kind[ord("A") : ord("Z") + 1] = 0
    return kind


KIND = _classes()


def _hashed(values: np.ndarray, bits: int) -> np.ndarray:
    return (values * np.uint32(2654435761)) >> np.uint32(32 - bits)


def _shape_grams(words: list[bytes]) -> Iterator[np.ndarray]:
    ids = np.fromiter(map(hash, words), dtype=np.int64, count=len(words))
    first = KIND[np.fromiter((w[0] for w in words), dtype=np.uint8, count=len(words))]
    last = KIND[np.fromiter((w[-1] for w in words), dtype=np.uint8, count=len(words))]
    back = np.zeros(len(words), dtype=np.uint32)
    for d in (4, 3, 2, 1):
        back[d:][ids[d:] == ids[:-d]] = d
    shape = 1 + first * 25 + last * 5 + back
    for n in (1, 2, 3):
        gram = np.zeros(max(0, len(words) - n + 1), dtype=np.uint32)
        for i in range(n):
            gram = gram * np.uint32(127) + shape[i : i + len(gram)]
        yield _hashed(gram + np.uint32(n << 24), SHAPE_BITS)


def present(text: str) -> np.ndarray:
    """Sorted numbers of the n-grams that occur in ``text``."""
    raw, seen = text.encode("utf-8", "surrogatepass"), np.zeros(SIZE, dtype=bool)
    b = np.frombuffer(raw, dtype=np.uint8)
    for start in range(0, len(b), BLOCK):
        part = b[start : start + BLOCK + 2].astype(np.uint32)
        pair = (part[:-1] << np.uint32(8)) | part[1:]
        seen[pair] = True
        seen[PAIR_SIZE + _hashed((pair[:-1] << np.uint32(8)) | part[2:], TRIPLE_BITS)] = True
    words = raw.split()
    for start in range(0, len(words), BLOCK):
        for gram in _shape_grams(words[max(0, start - 4) : start + BLOCK]):
            seen[PAIR_SIZE + (1 << TRIPLE_BITS) + gram] = True
    return np.flatnonzero(seen)


@dataclass
class Model:
    """margin = (sum of weights of present n-grams + offset) / length of the scaled indicators, the constant 1 included."""

    weights: np.ndarray
    squares: np.ndarray
    offset: float
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, features: np.ndarray) -> float:
        return (float(self.weights[features].sum()) + self.offset) / np.sqrt(1.0 + float(self.squares[features].sum()))

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(present(text)) + self.shift, -30, 30))))


def log_ratios(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Log ratio of an n-gram's smoothed share of documents in the two classes."""
    good, bad = np.full(SIZE, smooth), np.full(SIZE, smooth)
    for features, label in zip(rows, y, strict=True):
        (good if label > 0 else bad)[features] += 1
    return np.log(good / (2 * smooth + (y > 0).sum())) - np.log(bad / (2 * smooth + (y < 0).sum()))


def dual_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, bound: np.ndarray, rounds: int, seed: int) -> tuple[np.ndarray, float]:
    """L2-regularised hinge loss by dual coordinate descent; rows have unit length, ``bound`` caps each dual value."""
    lengths = [np.sqrt(1.0 + float(scale[f] @ scale[f])) for f in rows]
    w, w0, alpha, rng = np.zeros(len(scale)), 0.0, np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            values = scale[rows[i]] / lengths[i]
            slope = y[i] * (w[rows[i]] @ values + w0 / lengths[i]) - 1
            new = min(max(alpha[i] - slope, 0.0), bound[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * values
                w0 += step / lengths[i]
                alpha[i] = new
    return w, w0


def logistic_fit(margin: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of a weighted logistic curve through (margin, 0/1) by Newton steps with a small ridge."""
    unit = float(np.std(margin)) or 1.0
    x, at, ridge = np.stack([margin / unit, np.ones_like(margin)]), np.array([1.0, 0.0]), 1e-2
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(at @ x, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))) @ x.T + ridge * np.eye(2), x @ (weight * (p - y)) + ridge * at)
        at = at - step
        if np.abs(step).max() < 1e-6:
            break
    return max(float(at[0]), 1e-3) / unit, float(at[1])


def fit(rows: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, c: float = 1.0, rounds: int = 12, seed: int = 5) -> Model:
    """Fit on four fifths of the rows; the others, weighted back to the labels' frequencies, give the score curve."""
    y = np.where(labels > 0, 1.0, -1.0)
    order = np.random.default_rng(seed).permutation(len(rows))
    held, used = order[::5], order[np.arange(len(rows)) % 5 != 0]
    if any(len(set(y[part])) < 2 for part in (held, used)):
        held = used = order
    if len(set(y)) < 2:
        return Model(np.zeros(SIZE), np.zeros(SIZE), 0.0)
    part, sign = [rows[i] for i in used], y[used]
    bound = c * len(used) / (2 * np.where(sign > 0, (sign > 0).sum(), (sign < 0).sum()))
    scale = log_ratios(part, sign)
    w, w0 = dual_descent(part, sign, scale, bound, rounds, seed)
    model = Model(w * scale, scale * scale, w0)
    margins = np.array([model.margin(rows[i]) for i in held])
    model.slope, model.shift = logistic_fit(margins, (y[held] > 0).astype(float), weight[held])
    return model


def train(docs: DataFrame, labels: DataFrame, cap: int = 4000) -> Model:
    """A model from ``labels(doc_id, quality)``: at most ``cap`` documents of each class."""
    known = labels.where("quality in (0, 1)").select(F.col("doc_id"), F.col("quality").cast("int").alias("quality"))

    @F.pandas_udf(BinaryType())
    def grams(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([present(t).astype("<i4").tobytes() for t in texts], dtype=object)

    rows = with_features(docs, spread(known, "quality", cap), grams(text_or_empty())).orderBy("doc_id", "quality").toPandas()
    features = [np.frombuffer(f, dtype="<i4") for f in rows["features"]]
    return fit(features, rows["quality"].to_numpy(), rows["weight"].to_numpy())


def scores(docs: DataFrame, labels: DataFrame, cap: int = 4000, folds: int = 4, held: int = 2, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted for every row; labels of fold ``held`` are never learnt."""
    fold = crc_fold("doc_id", folds)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels.where(fold != held), cap))

    @F.pandas_udf(DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shared.value.score(t) for t in texts], dtype="float64")

    return docs.select("doc_id", (fold == held).alias("held_out"), score(text_or_empty()).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_rejected(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose own text the classifier accepts, with all their columns."""
    threshold = options.pop("threshold", 0.7)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels.where(crc_fold("doc_id", options.pop("folds", 4)) != options.pop("held", 2)), **options))

    @F.pandas_udf(DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shared.value.score(t) for t in texts], dtype="float64")

    return docs.where(score(text_or_empty()) >= threshold)
