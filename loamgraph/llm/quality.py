"""Quality by naive Bayes support vectors.

Indicators of n-grams are scaled by their class log-count ratio, rows are brought to unit length, and a linear
hinge-loss model over them is fitted by dual coordinate descent. The n-grams are words (1 and 2), word shapes
(1 to 3: runs of capitals, letters, digits and each other sign, as in ``Aa,``) and repetitions (the same word two,
three or four times in a row), so symbol noise, shouting, tables and stuttering are n-grams too.

Fitted on at most ``LIMIT`` labelled rows outside the held-out fifth; a fifth of those fits the logistic map from
margins to scores. Only the text is an input of the score.

Defined results: null and empty texts have no n-gram and score the map of the bias; repeated rows are scored
alike; without labels of both classes every score is the share of label 1 (0 without labels); an empty table gives
an empty result; extra columns are not looked at by ``score`` and kept by ``clean``. A null id is not held out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame

from .common import table
from .labelled import PLAIN, fitted, passing, sample, scored
from .toxicity import lazily

#: Labelled rows that the model is fitted on, at most; hash bits; fewest rows of an n-gram that counts.
LIMIT, BITS, LEAST = 6000, 20, 3
ALPHA, COST, EPOCHS, THRESHOLD = 1.0, 1.0, 30, 0.3
SHAPE = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)
_SHAPES: dict[bytes, int] = {}


def _shape(word: bytes) -> int:
    """The hash of a word's shape; words of the same shape are looked up once."""
    if (h := _SHAPES.get(word)) is None:
        if len(_SHAPES) > 100_000:
            _SHAPES.clear()
        h = _SHAPES[word] = crc32(_RUN.sub(rb"\1", word))
    return h


def terms(text: str) -> np.ndarray:
    """The distinct buckets of a text's n-grams."""
    raw = text.encode()
    chunks = raw.split()
    s = np.fromiter(map(_shape, raw.translate(SHAPE).split()), np.uint32, len(chunks)).astype(np.uint64)
    words = raw.lower().translate(PLAIN).split()
    w = np.fromiter(map(crc32, words), np.uint32, len(words)).astype(np.uint64)
    c = np.fromiter(map(crc32, chunks), np.uint32, len(chunks))
    m = np.uint64(0x9E3779B97F4A7C15)
    same = c[1:] == c[:-1]
    runs = [k for k in (1, 2, 3) if len(same) >= k and np.lib.stride_tricks.sliding_window_view(same, k).all(1).any()]
    s2 = s[:-1] * m + s[1:]
    parts = [w * m, (w[:-1] * m + w[1:]) * m, (s + np.uint64(1)) * m, (s2 + np.uint64(2)) * m, ((s2[:-1] * m + s[2:]) + np.uint64(3)) * m, np.array(runs, np.uint64) * m]
    return np.unique((np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.uint32))


@dataclass
class Model:
    """ratio: log-count ratio of each n-gram in use; weight: its weight times that ratio; scale and shift map margins."""

    grams: np.ndarray
    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    scale: float
    shift: float

    def margins(self, found) -> np.ndarray:
        at = np.full(1 << BITS, -1, np.int32)
        at[self.grams] = np.arange(len(self.grams), dtype=np.int32)
        square = self.ratio**2
        out = np.full(len(found), self.bias)
        for k, x in enumerate(found):
            i = at[x]
            if len(i := i[i >= 0]):
                out[k] += self.weight[i].sum() / np.sqrt(square[i].sum() or 1.0)
        return out

    def scorer(self):
        return lambda texts: 1 / (1 + np.exp(-np.clip(self.scale * self.margins(map_terms(texts)) + self.shift, -35, 35)))


def map_terms(texts):
    return [terms(t) for t in texts]


def descend(rows: list[np.ndarray], y: np.ndarray, width: int, values: np.ndarray) -> np.ndarray:
    """Dual coordinate descent for the hinge loss: alpha_i in [0, COST / share of its class], one row at a time."""
    rng, w = np.random.default_rng(5), np.zeros(width + 1)
    scaled = [values[r] / np.sqrt((values[r] ** 2).sum() or 1.0) for r in rows]
    diag = np.array([(x**2).sum() + 1 for x in scaled])
    top = np.where(y > 0, COST * len(y) / (2 * max(1, (y > 0).sum())), COST * len(y) / (2 * max(1, (y < 0).sum())))
    alpha = np.zeros(len(y))
    for _ in range(EPOCHS):
        moved = 0.0
        for i in rng.permutation(len(y)):
            r, x = rows[i], scaled[i]
            g = y[i] * (w[r] @ x + w[width]) - 1
            new = min(max(alpha[i] - g / diag[i], 0.0), top[i])
            if (d := new - alpha[i]) != 0:
                alpha[i] = new
                w[r] += d * y[i] * x
                w[width] += d * y[i]
                moved = max(moved, abs(d))
        if moved < 1e-3:
            break
    return w


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of the logistic map, by damped Newton steps on smoothed targets."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
        g = np.array([((p - t) * margin).sum() + 1e-3 * a, (p - t).sum()])
        q = p * (1 - p)
        h = np.array([[(q * margin**2).sum() + 1e-3, (q * margin).sum()], [(q * margin).sum(), q.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def fit(found: list[np.ndarray], label: np.ndarray) -> Model:
    none = np.zeros(0, np.int64)
    n, n1 = len(label), int(label.sum())
    if not 0 < n1 < n:
        share = n1 / n if n else 0.0
        return Model(none, np.zeros(0), np.zeros(0), 0.0, 1.0, float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    y = np.where(label == 1, 1, -1)
    flat, row = np.concatenate(found), np.repeat(np.arange(n), [len(x) for x in found])
    df = np.bincount(flat, minlength=1 << BITS)
    df1 = np.bincount(flat[y[row] > 0], minlength=1 << BITS)
    p, q = (ALPHA + df1) / (2 * ALPHA + n1), (ALPHA + df - df1) / (2 * ALPHA + n - n1)
    grams = np.flatnonzero(df >= LEAST)
    ratio = np.log(p[grams] / q[grams])
    at = np.full(1 << BITS, -1)
    at[grams] = np.arange(len(grams))
    rows = [(i := at[x])[i >= 0] for x in found]
    # every fifth row of each class fits the map, the others the weights
    turn = np.zeros(n, np.int64)
    for c in (1, -1):
        turn[y == c] = np.arange((y == c).sum())
    tune = turn % 5 == 4
    use = np.flatnonzero(~tune)
    w = descend([rows[i] for i in use], y[use], len(grams), ratio)
    model = Model(grams, ratio, w[:-1] * ratio, float(w[-1]), 1.0, 0.0)
    if 0 < (y[tune] > 0).sum() < tune.sum():
        model.scale, model.shift = logistic(model.margins([found[i] for i in np.flatnonzero(tune)]), y[tune])
    return model


def train(docs: DataFrame, labels: DataFrame, limit: int = LIMIT) -> Model:
    return Model(**fitted(sample(docs, labels, "quality", limit), terms, lambda found, y: vars(fit(found, y))))


def score(docs: DataFrame, model: Model) -> DataFrame:
    return scored(docs, lazily(model), THRESHOLD)


def clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least the threshold."""
    return passing(docs, lazily(model), lambda s: s >= threshold)


def op4_quality(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
