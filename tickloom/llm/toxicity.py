"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; documents sampled from the whole corpus,
whatever their label, are the unlabelled set, which contains toxic ones too.  With class
prior ``p`` the risk of a scorer g is

    p * E_pos[loss(g)] + max(0, E_unl[loss(-g)] - p * E_pos[loss(-g)])

and the second term, the risk on the clean part, may not fall below zero: where it does,
the step goes the other way (the published non-negative estimator).  g is linear in the indicators of
a document's words and word stems (by how often a stem occurs, which catches inflected
forms), each scaled by how much more often positives have it than unlabelled
documents (a log ratio, where it is certain), and fitted in numpy by full-batch adaptive
steps under the logistic loss, so its logistic value estimates the probability of being
toxic.  ``p`` is the share of toxic documents among the labelled ones.

The fit uses at most ``positives`` toxic and ``unlabelled`` other documents, chosen by
hash (parameters), less their copies and near copies.  Scores read every whole text.

Cases: null and empty texts have no marks and score by the offset; null labels are not
used; a document labelled twice counts twice; without positives every score is 0; an
empty table gives no rows; columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType

from .common import crc_fold, text_or_empty
from .fitting import spread, with_features

BITS = 20
TRIPLES = 8
WORD = re.compile(r"[^\W\d_]+")
STEMS = (4, 6)  # characters of a word's beginning
LEVELS = (1, 2, 4)  # how often a stem occurs at least


def marks_of(text: str) -> np.ndarray:
    """Numbers (hashes) of the distinct lower-case words of ``text`` and of its stems, by how often they occur."""
    counts = Counter(WORD.findall(text.lower()))
    names = list(counts)
    for n in STEMS:
        stems: Counter[str] = Counter()
        for word, times in counts.items():
            if len(word) >= n:
                stems[word[:n]] += times
        names += [f"{stem}+{level}" for stem, times in stems.items() for level in LEVELS if times >= level]
    return np.fromiter({zlib.crc32(m.encode("utf-8", "surrogatepass")) >> (32 - BITS) for m in names}, dtype=np.int64)


@dataclass
class Model:
    weights: np.ndarray
    offset: float

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[marks_of(text)].sum() + self.offset, -30, 30))))


def one_per_copy(rows: list[np.ndarray], seed: int = 3) -> list[np.ndarray]:
    """Word sets without copies and most near copies, so that a text repeated by the thousand counts once.

    Two sets go together when any of the triples of minimum hashes agrees.
    """
    factors = np.random.default_rng(seed).integers(1 << 31, 1 << 32, (3 * TRIPLES, 1)) | 1
    seen, kept = set(), []
    for row in rows:
        least = ((factors * (row + 1)) & 0xFFFFFFFF).min(axis=1).tolist() if len(row) else [-1] * len(factors)
        marks = {(k, *least[3 * k : 3 * k + 3]) for k in range(TRIPLES)}
        if not marks & seen:
            kept.append(row)
        seen |= marks
    return kept


def documents_with(rows: list[np.ndarray]) -> np.ndarray:
    """Number of rows that have each mark, row by row, so that the sample is never copied end to end."""
    out = np.zeros(1 << BITS)
    for row in rows:
        out[row] += 1
    return out


def contrast(positive: list[np.ndarray], unlabelled: list[np.ndarray], doubt: float) -> np.ndarray:
    """Log of how much more often the positives have a word; 0 where the difference may be chance.

    A word counts if its square-root counts differ by ``doubt`` standard errors (1/2 each),
    so chance words get no weight, however many of them a long text has.
    """
    own, usual = documents_with(positive), documents_with(unlabelled) * (len(positive) / len(unlabelled))
    sure = 2 * (np.sqrt(own) - np.sqrt(usual)) >= doubt
    return np.where(sure, np.maximum(0.0, np.log((own + 1.0) / (usual + 1.0))), 0.0)


class Bags:
    """Scaled word sets of a sample, end to end, with sums over documents and their transpose."""

    def __init__(self, rows: list[np.ndarray], scale: np.ndarray):
        rows = [r[scale[r] > 0] for r in rows]
        self.at, self.n = np.concatenate([*rows, np.zeros(0, dtype=np.int64)]).astype(np.int64), len(rows)
        self.owner = np.repeat(np.arange(self.n), [len(r) for r in rows])
        self.value = scale[self.at]

    def margins(self, model: Model) -> np.ndarray:
        return np.bincount(self.owner, model.weights[self.at] * self.value, self.n) + model.offset

    def back(self, slope: np.ndarray) -> tuple[np.ndarray, float]:
        """Gradient of mean(loss) for the slope of the loss at each document."""
        slope = slope / max(1, self.n)
        return np.bincount(self.at, slope[self.owner] * self.value, 1 << BITS), float(slope.sum())


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, doubt: float = 4.0, steps: int = 200, rate: float = 0.05, ridge: float = 3e-4) -> Model:
    """Non-negative PU fit on word sets."""
    model = Model(np.zeros(1 << BITS), -30.0)
    if not positive or not unlabelled:
        return model
    positive, unlabelled = one_per_copy(positive), one_per_copy(unlabelled)
    scale = contrast(positive, unlabelled, doubt)
    pos, unl = Bags(positive, scale), Bags(unlabelled, scale)
    model.offset = float(np.log(prior / (1 - prior)))
    first, second = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    for step in range(1, steps + 1):
        gp, gu = pos.margins(model), unl.margins(model)
        clean = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        # Gradients of the three risks; each loss is log(1 + exp(-margin)) or of the opposite sign.
        as_toxic, as_clean = pos.back(logistic(gp) - 1), pos.back(logistic(gp))
        rest = unl.back(logistic(gu))
        if clean >= 0:
            grad, bias = (prior * (as_toxic[i] - as_clean[i]) + rest[i] for i in (0, 1))
        else:
            grad, bias = (prior * as_clean[i] - rest[i] for i in (0, 1))
        grad = np.append(grad + ridge * model.weights, bias)
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-6)
        model.weights -= move[:-1]
        model.offset -= float(move[-1])
    model.weights *= scale
    return model


def bag_column(text: Column) -> Column:
    @F.pandas_udf(BinaryType())
    def bag(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([marks_of(t).astype("<i4").tobytes() for t in texts], dtype=object)

    return bag(text)


def train(docs: DataFrame, labels: DataFrame, allowed: Column, positives: int = 4000, unlabelled: int = 8000) -> Model:
    """A model from ``labels(doc_id, toxic)`` and the texts of ``docs``, both only where ``allowed`` (on doc_id) holds."""
    known = labels.where(allowed).where("toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("kind"))
    shares = {r[0]: r[1] for r in known.groupBy("kind").count().collect()}
    total = sum(shares.values())
    if not shares.get(1) or total == shares.get(1):
        return fit([], [], 0.5)
    confirmed = spread(known.where("kind = 1"), "kind", positives)
    anyone = spread(docs.where(allowed).select("doc_id", F.lit(2).alias("kind")), "kind", unlabelled, seed=12)
    rows = with_features(docs, confirmed.unionByName(anyone), bag_column(text_or_empty())).orderBy("doc_id", "kind").toPandas()
    bags = {kind: [np.frombuffer(b, dtype="<i4") for b in rows.loc[rows["kind"] == kind, "features"]] for kind in (1, 2)}
    return fit(bags[1], bags[2], shares[1] / total)


def scores(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, threshold: float = 0.7, **sizes) -> DataFrame:
    """doc_id, held_out, score and predicted for every row; documents of fold ``held`` are never learnt."""
    fold = crc_fold("doc_id", folds)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, fold != held, **sizes))

    @F.pandas_udf(DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shared.value.score(t) for t in texts], dtype="float64")

    return docs.select("doc_id", (fold == held).alias("held_out"), score(text_or_empty()).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
