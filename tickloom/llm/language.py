"""Language identification by a bidirectional gated recurrent network over bytes.

A text is read as UTF-8 bytes in chunks of ``CHUNK``.  Two gated recurrent layers run over
each chunk, one in either direction; from both states a softmax labels every byte position,
and the mean of a document's position probabilities is its distribution over languages.
The network is trained in numpy by back-propagation through time on bounded samples: at
most ``cap`` documents per language, chosen by hash, and ``WINDOWS`` chunks of each at
random places (parameters).  Scores read every byte of every text.

Cases: null texts and texts without a letter are ``und`` with score 1; null languages are
not learnt; without any language everything is ``und`` with score 0; repeated rows keep
their rows; an empty table gives no rows; columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StructField, StructType

from .common import crc_fold, text_or_empty
from .fitting import spread, with_features

CHUNK, WINDOWS, HIDDEN, BATCH = 64, 8, 6, 4096


def logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


@dataclass
class Layer:
    """One direction.  Rows of ``inputs`` and ``recur``: update gate, reset gate, candidate."""

    inputs: np.ndarray  # (3H, 256): contribution of each byte, bias included
    recur: np.ndarray  # (3H, H)
    bias: np.ndarray  # (H, 1): of the candidate's recurrent part

    @staticmethod
    def fresh(rng: np.random.Generator, h: int) -> Layer:
        return Layer(*(rng.normal(0, s, shape).astype(np.float32) for s, shape in ((0.3, (3 * h, 256)), (h**-0.5, (3 * h, h)), (0.01, (h, 1)))))

    def step(self, codes: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, ...]:
        h = len(state)
        a, u = np.take(self.inputs, codes, axis=1), self.recur @ state
        gates = logistic(a[: 2 * h] + u[: 2 * h])
        update, reset, inner = gates[:h], gates[h:], u[2 * h :] + self.bias
        new = np.tanh(a[2 * h :] + reset * inner)
        return new + update * (state - new), update, reset, inner, new

    def run(self, codes: np.ndarray, order: range, mask: np.ndarray | None) -> Iterator[tuple[int, np.ndarray]]:
        """(t, state) along ``order``, the state overwritten by each step: ``step`` without new arrays.

        Gates are 1/2 + tanh(x/2)/2, so gate rows and the candidate's recurrent part are halved beforehand.
        """
        h, b = len(self.bias), codes.shape[1]
        halved = np.repeat(np.array([0.5, 0.5, 1.0], np.float32), h)[:, None]
        inputs, recur, bias = self.inputs * halved, self.recur * np.float32(0.5), self.bias * np.float32(0.5)
        a, u, state = np.empty((3 * h, b), np.float32), np.empty((3 * h, b), np.float32), np.zeros((h, b), np.float32)
        gates, update, reset, new, inner = a[: 2 * h], a[:h], a[h : 2 * h], a[2 * h :], u[2 * h :]
        for t in order:
            np.take(inputs, codes[t], axis=1, out=a, mode="clip")
            np.matmul(recur, state, out=u)
            gates += u[: 2 * h]
            np.tanh(gates, out=gates)
            inner += bias
            new += inner
            inner *= reset
            new += inner
            np.tanh(new, out=new)
            state -= new
            update += np.float32(1)
            update *= np.float32(0.5)
            state *= update
            state += new
            if mask is not None:
                state *= mask[t]
            yield t, state

    def states(self, codes: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        """States after each step of (T, B) codes, as (T, H, B); masked steps leave a zero state."""
        state, out = np.zeros((len(self.bias), codes.shape[1]), np.float32), np.empty((len(codes), len(self.bias), codes.shape[1]), np.float32)
        for t in range(len(codes)):
            state = self.step(codes[t], state)[0]
            if mask is not None:
                state *= mask[t]
            out[t] = state
        return out

    def gradients(self, codes: np.ndarray, mask: np.ndarray, d_states: np.ndarray) -> list[np.ndarray]:
        """Back-propagation through time of ``d_states`` (T, H, B) to the three arrays."""
        h, steps, state = len(self.bias), [], np.zeros(d_states.shape[1:], np.float32)
        for t in range(len(codes)):
            new_state, *parts = self.step(codes[t], state)
            steps.append((state, *parts))
            state = new_state * mask[t]
        d_recur, d_bias, d_codes = np.zeros_like(self.recur), np.zeros_like(self.bias), np.empty((len(codes), 3 * h, codes.shape[1]), np.float32)
        back = np.zeros_like(state)
        for t in range(len(codes) - 1, -1, -1):
            before, update, reset, inner, new = steps[t]
            d = (d_states[t] + back) * mask[t]
            d_new = d * (1 - update) * (1 - new * new)
            d_update = d * (before - new) * update * (1 - update)
            d_reset = d_new * inner * reset * (1 - reset)
            d_inner = d_new * reset
            d_codes[t] = np.concatenate([d_update, d_reset, d_new])
            d_u = np.concatenate([d_update, d_reset, d_inner])
            d_recur += d_u @ before.T
            d_bias += d_inner.sum(axis=1, keepdims=True)
            back = d * update + self.recur.T @ d_u
        flat = codes.ravel()
        d_inputs = np.stack([np.bincount(flat, d_codes[:, k].ravel(), 256) for k in range(3 * h)]).astype(np.float32)
        return [d_inputs, d_recur, d_bias]


@dataclass
class Network:
    languages: list[str]
    forward: Layer
    backward: Layer
    out: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # (L, 2H + 1), the last column is the bias

    def both(self, codes: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        """(T, 2H, B) states of both directions, each seeing its own side of the position and the byte itself."""
        turned = None if mask is None else mask[::-1]
        return np.concatenate([self.forward.states(codes, mask), self.backward.states(codes[::-1], turned)[::-1]], axis=1)

    def positions(self, states: np.ndarray) -> np.ndarray:
        """(L, B) probabilities at one position."""
        x = self.out[:, :-1] @ states + self.out[:, -1:]
        x = np.exp(x - x.max(axis=0))
        return x / x.sum(axis=0)

    def chunk_sums(self, codes: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        """(L, B): position probabilities summed over each chunk, in place in a few arrays that stay in cache."""
        h, b = len(self.forward.bias), codes.shape[1]
        ahead, total = np.empty((len(codes), h, b), np.float32), np.zeros((len(self.languages), b), np.float32)
        for t, state in self.forward.run(codes, range(len(codes)), mask):
            ahead[t] = state
        left, right, bias = (np.ascontiguousarray(w) for w in np.split(self.out, [h, 2 * h], axis=1))
        p, q, norm = np.empty_like(total), np.empty_like(total), np.empty(b, np.float32)
        for t, state in self.backward.run(codes, range(len(codes) - 1, -1, -1), mask):
            np.matmul(left, ahead[t], out=p)
            p += np.matmul(right, state, out=q)
            p += bias
            np.exp(np.clip(p, -40, 40, out=p), out=p)
            np.sum(p, axis=0, out=norm)
            p /= norm
            if mask is not None:
                p *= mask[t]
            total += p
        return total

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """(documents, L): mean position probabilities; all zero for an empty text."""
        sums = np.zeros((len(texts), len(self.languages)))
        for rows, owner, sizes in chunked(texts):
            mask = None if (sizes == CHUNK).all() else (np.arange(CHUNK)[:, None] < sizes).astype(np.float32)
            np.add.at(sums, owner, self.chunk_sums(np.ascontiguousarray(rows.T), mask).T)
        return sums / np.maximum(1, np.array([len(t) for t in texts]))[:, None]


def chunked(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of all texts in batches: bytes (B, CHUNK), the text each belongs to, and its length.

    Full chunks and the shorter last ones go in batches of their own, so that most need no mask.
    """
    arrays = [np.frombuffer(t, np.uint8) for t in texts]
    full = np.array([len(a) // CHUNK for a in arrays], dtype=np.int64)
    bounds = np.concatenate([[0], np.cumsum(full)])
    for start in range(0, int(bounds[-1]), BATCH):
        owner = np.searchsorted(bounds, np.arange(start, min(start + BATCH, int(bounds[-1]))), side="right") - 1
        rows = []
        for i in np.unique(owner):
            first = max(0, start - int(bounds[i]))
            n = int((owner == i).sum())
            rows.append(arrays[i][first * CHUNK : (first + n) * CHUNK].reshape(n, CHUNK))
        yield np.concatenate(rows), owner, np.full(len(owner), CHUNK)
    tails = [i for i, a in enumerate(arrays) if len(a) % CHUNK]
    for start in range(0, len(tails), BATCH):
        group = tails[start : start + BATCH]
        rows = np.zeros((len(group), CHUNK), np.uint8)
        sizes = np.array([len(arrays[i]) % CHUNK for i in group])
        for k, i in enumerate(group):
            rows[k, : sizes[k]] = arrays[i][len(arrays[i]) - sizes[k] :]
        yield rows, np.array(group), sizes


def fit(rows: np.ndarray, sizes: np.ndarray, labels: np.ndarray, languages: list[str], hidden: int = HIDDEN, steps: int = 200, batch: int = 256, rate: float = 0.02, seed: int = 9) -> Network:
    """Train on chunks (N, CHUNK) with the language number of each, by adaptive steps on random batches."""
    rng = np.random.default_rng(seed)
    net = Network(languages, Layer.fresh(rng, hidden), Layer.fresh(rng, hidden), rng.normal(0, 0.1, (len(languages), 2 * hidden + 1)).astype(np.float32))
    weights = [getattr(layer, name) for layer in (net.forward, net.backward) for name in ("inputs", "recur", "bias")] + [net.out]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    # Every language is drawn as often as any other.
    share = 1.0 / np.maximum(1, np.bincount(labels, minlength=len(languages)))[labels]
    share /= share.sum()
    for step in range(1, steps + 1):
        chosen = rng.choice(len(rows), batch, p=share)
        codes, y = np.ascontiguousarray(rows[chosen].T), labels[chosen]
        mask = (np.arange(CHUNK)[:, None] < sizes[chosen]).astype(np.float32)
        states = net.both(codes, mask)
        d_states, d_out, scale = np.empty_like(states), np.zeros_like(net.out), 1.0 / mask.sum()
        for t in range(CHUNK):
            d = net.positions(states[t])
            d[y, np.arange(batch)] -= 1
            d *= mask[t] * scale
            d_out[:, :-1] += d @ states[t].T
            d_out[:, -1] += d.sum(axis=1)
            d_states[t] = net.out[:, :-1].T @ d
        grads = net.forward.gradients(codes, mask, d_states[:, :hidden]) + net.backward.gradients(codes[::-1], mask[::-1], d_states[::-1, hidden:]) + [d_out]
        pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for w, g, m, v in zip(weights, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def sample_windows(text: str, seed: int = 1) -> bytes:
    """Up to WINDOWS chunks from random places of a text, each led by its length."""
    raw = text.encode("utf-8", "surrogatepass")
    rng = np.random.default_rng([seed, len(raw)])
    starts = rng.integers(0, max(1, len(raw) - CHUNK + 1), WINDOWS if len(raw) > CHUNK else 1)
    parts = (raw[s : s + CHUNK] for s in starts)
    return b"".join(bytes([len(p)]) + p.ljust(CHUNK, b"\0") for p in parts if p)


def train(docs: DataFrame, cap: int = 500, **options) -> Network | None:
    """A network from the non-null ``lang`` of ``docs``: at most ``cap`` documents of each language."""
    known = docs.where("lang is not null").select("doc_id", F.col("lang").cast("string").alias("lang"))

    @F.pandas_udf(BinaryType())
    def windows(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([sample_windows(t) for t in texts], dtype=object)

    rows = with_features(docs.where(text_or_empty().rlike(r"\p{L}")), spread(known, "lang", cap), windows(text_or_empty())).orderBy("doc_id", "lang").toPandas()
    if rows.empty:
        return None
    languages = sorted(set(rows["lang"]))
    numbers = rows["lang"].map(languages.index).to_numpy()
    cut = [np.frombuffer(b, np.uint8).reshape(-1, CHUNK + 1) for b in rows["features"]]
    everything = np.concatenate(cut)
    return fit(everything[:, 1:], everything[:, 0].astype(np.int64), np.repeat(numbers, [len(c) for c in cut]), languages, **options)


def predictions(docs: DataFrame, folds: int = 4, held: int = 2, **options) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row; documents of fold ``held`` are never learnt."""
    fold = crc_fold("doc_id", folds)
    net = train(docs.where(fold != held), **options)
    text = text_or_empty()
    base = docs.select("doc_id", (fold == held).alias("held_out"), text.alias("_text"))
    if net is None:
        return base.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(net)
    shape = StructType([StructField("number", IntegerType()), StructField("score", DoubleType())])

    @F.pandas_udf(shape)
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            pooled = shared.value.pooled([t.encode("utf-8", "surrogatepass") for t in texts])
            best = pooled.argmax(axis=1)
            yield pd.DataFrame({"number": best.astype(np.int32), "score": np.clip(pooled[np.arange(len(best)), best], 0, 1)})

    names = F.array(*[F.lit(x) for x in net.languages])
    lettered = F.col("_text").rlike(r"\p{L}")
    return base.withColumn("_p", label("_text")).select(
        "doc_id",
        "held_out",
        F.when(lettered, F.get(names, F.col("_p.number"))).otherwise(F.lit("und")).alias("lang_pred"),
        F.when(lettered, F.col("_p.score")).otherwise(F.lit(1.0)).alias("score"),
    )
