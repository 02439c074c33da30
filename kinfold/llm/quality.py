"""Quality classifier: naive Bayes support vectors.

Binary n-gram indicators are scaled by the log ratio of the classes' smoothed
counts; a linear hinge-loss model is fitted on the scaled indicators by dual
coordinate descent, pulled towards its mean weight, and its margins are mapped
to probabilities on rows kept out of the fit. N-grams are words and pairs of
words, and one to three shapes of words in a row; a shape tells capitals,
other signs, the last sign, the length and whether the word repeats the one
before. They are hashed into ``2 ** BUCKET_BITS`` buckets.

The model is fitted on at most ``SAMPLE`` labelled rows, the first by a hash
of the id. Scores look at the whole text and at nothing else.

Defined cases: null and empty texts have no n-gram and get the score of the
intercept; null ids carry no label; labels other than 0 and 1 are not used; of
repeated labels of an id the largest holds; without labels of both classes
every score is the share of ones, or a half; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text
from ._work import trimmed

SAMPLE = 5_000
BUCKET_BITS = 18
BETA, COST, EPOCHS = 0.25, 1.0, 20
_U = np.uint64


def features(held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of all texts, one after another, and offsets of each text's."""
    h, offsets, starts, ends, data = _text.words(held)
    counts = np.diff(offsets)
    doc = np.repeat(np.arange(len(counts)), counts)
    if not len(h):
        return np.zeros(0, np.int32), np.zeros(len(held) + 1, np.int64)

    def tally(which: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(which[data])))
        return total[ends] - total[starts]

    kinds = np.zeros((3, 256), np.int64)
    kinds[0, 65:91] = 1
    kinds[1, [c for c in range(33, 128) if not chr(c).isalnum()]] = 1
    kinds[2, 48:58] = 1
    upper, signs, digits = (tally(k) for k in kinds)
    size = ends - starts
    same = np.concatenate(([False], (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])))
    last = np.where(kinds[1][data[ends - 1]] > 0, data[ends - 1], 0).astype(np.int64)
    shape = (np.minimum(upper, 2) + 3 * np.minimum(signs, 3) + 12 * np.minimum(digits, 1) + 24 * np.digitize(size, [3, 6, 10, 16]) + 120 * same + 240 * last).astype(_U)
    shape = _text.mix64(shape + _U(0x1234567))
    mask = _U((1 << BUCKET_BITS) - 1)

    def grams(x: np.ndarray, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        if len(x) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        out = np.zeros(len(x) - n + 1, _U)
        for k in range(n):
            out = _text.mix64(out + x[k : k + len(out)] + _U(seed))
        ok = doc[: len(out)] == doc[n - 1 :]
        return (out & mask).astype(np.int64)[ok], doc[: len(out)][ok]

    parts = [grams(h, 1, 1), grams(h, 2, 2), grams(shape, 1, 3), grams(shape, 2, 4), grams(shape, 3, 5)]
    both = np.unique(np.concatenate([(d << BUCKET_BITS) | g for g, d in parts]))
    owner = both >> BUCKET_BITS
    return (both & int(mask)).astype(np.int32), np.searchsorted(owner, np.arange(len(held) + 1))


def hinge_fit(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and intercept of the L1-loss linear SVM on indicators times ``scale``, by dual coordinate descent."""
    w, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    square = np.array([float((scale[r] ** 2).sum()) + 1.0 for r in rows])
    weight = cost * len(y) / 2 / np.where(y > 0, max((y > 0).sum(), 1), max((y < 0).sum(), 1))
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            r = rows[i]
            x = scale[r]
            gradient = y[i] * (w[r] @ x + bias) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), weight[i])
            step = (new - alpha[i]) * y[i]
            if step:
                most = max(most, abs(step))
                alpha[i] = new
                w[r] += step * x
                bias += step
        if most < 1e-4:
            break
    return w, bias


def sigmoid_fit(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic that maps margins to probabilities; smoothed targets, Newton steps."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    goal = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, float(np.log((pos + 1) / (neg + 1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - goal) * margins).sum() + 1e-3 * a, (p - goal).sum()])
        q = np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[(q * margins**2).sum() + 1e-3, (q * margins).sum()], [(q * margins).sum(), q.sum()]]) + 1e-9 * np.eye(2)
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return (float(a), float(b)) if a > 0 else (1e-6, float(np.log((pos + 1) / (neg + 1))))


def labelled(docs: DataFrame, labels: DataFrame, label: str, usable: Column, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """text and y of at most ``sample`` labelled rows for which ``usable`` (a condition on ``id``) holds."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull() & usable)
    known = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id").select("id", "text", "y")  # at most sample rows


def _featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for first, held in _text.chunks(b["text"].tolist(), lower=False):
            f, offsets = features(held)
            part = b.iloc[first : first + len(held)]
            yield pd.DataFrame({"id": part["id"].array, "y": part["y"].array, "f": [f[x:z] for x, z in zip(offsets[:-1], offsets[1:], strict=True)]})


class Model:
    """weights of the buckets, intercept, slope and offset of the logistic."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, offset: float) -> None:
        self.weights, self.bias, self.slope, self.offset = weights.astype(np.float32), bias, slope, offset

    def score(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -30, 30)))

    def margins(self, f: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0.0], np.cumsum(self.weights[f], dtype=np.float64)))
        return total[offsets[1:]] - total[offsets[:-1]] + self.bias


def train(rows: DataFrame) -> Model:
    """Fit on rows of id, text, y."""
    got = rows.mapInPandas(trimmed(_featured), f"id {rows.schema['id'].dataType.simpleString()}, y int, f array<int>").toPandas()
    got = got.sort_values("id").reset_index(drop=True)
    y = np.where(got["y"].to_numpy(np.int64) > 0, 1.0, -1.0) if len(got) else np.zeros(0)
    if len(set(y)) < 2:
        share = float((y > 0).mean()) if len(y) else 0.5
        return Model(np.zeros(1 << BUCKET_BITS), 0.0, 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    own = [np.asarray(f, np.int64) for f in got["f"]]
    fold = np.arange(len(own)) % 5 == 0
    fit = ~fold if len({*y[~fold]}) == 2 and len({*y[fold]}) == 2 else np.ones(len(own), bool)
    check = fold if not fit.all() else fit
    p, q = np.ones(1 << BUCKET_BITS), np.ones(1 << BUCKET_BITS)
    for f, one, use in zip(own, y, fit, strict=True):
        if use:
            (p if one > 0 else q)[f] += 1
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    rows_fit = [f for f, use in zip(own, fit, strict=True) if use]
    w, bias = hinge_fit(rows_fit, y[fit], ratio)
    mean = np.abs(w).mean()
    pulled = ((1 - BETA) * mean + BETA * w) * ratio
    margins = np.array([pulled[f].sum() + BETA * bias for f in own])
    slope, offset = sigmoid_fit(margins[check], y[check])
    return Model(pulled, BETA * bias, slope, offset)


def scores(docs: DataFrame, model: Model, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted. ``held_out``: a condition on the id column."""

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for first, held in _text.chunks(b["text"].tolist(), lower=False):
                f, offsets = features(held)
                s = model.score(model.margins(f, offsets))
                part = b.iloc[first : first + len(held)]
                yield pd.DataFrame({"id": part["id"].array, "held_out": part["held_out"].array, "score": s, "predicted": (s >= 0.5).astype(np.int32)})

    own = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return own.mapInPandas(trimmed(scored), f"id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
