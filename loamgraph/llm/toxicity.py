"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(w0 + sum w_i + sum_{i<j} <v_i, v_j>) over the distinct hashed terms of the whole text. The pair
term gives weight to combinations (an insult with a group mention) that additive weights miss. Terms are hashed
to 2**20 buckets; the machine's inputs are all those whose share among toxic and other texts differs by ``Z``
standard errors, and all in some pair whose share of toxic texts is ``JOINT`` standard errors off what the two terms
give apart, so a term that tells something only beside another one is an input too. Inputs are not capped.

Fitted in one task on at most ``LIMIT`` labelled rows outside the held-out fifth. Only the text is an input of the score.

Defined results: null and empty texts score the intercept; repeated rows are scored alike; without labels of both
classes every score is the share of toxic labels (0 without labels); an empty table gives an empty result; extra
columns are not looked at by ``score`` and kept by ``clean``. A null id is not held out.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame

from .common import table
from .labelled import PLAIN, fitted, passing, sample, scored

#: Labelled rows that the machine is fitted on, at most; hash bits; least z of an input by itself and in a pair; least
#: share of the rows that a term of a tested pair is in; terms in a side of the squares of pairs.
LIMIT, BITS, Z, JOINT, SHARE, SIDE = 8000, 20, 4.0, 6.0, 0.01, 512
FACTORS, STEPS, BATCH, RATE, DECAY = 8, 2500, 128, 0.05, 1e-3


def terms(text: str) -> np.ndarray:
    """The distinct buckets of a text's lower-cased words."""
    words = set(text.lower().encode().translate(PLAIN).split())
    return np.unique(np.fromiter(map(crc32, words), np.uint32, len(words)) & np.uint32((1 << BITS) - 1))


@dataclass
class Machine:
    """inputs: the buckets in use, ascending; w0, w, v: the weights."""

    inputs: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def scorer(self):
        inputs, w0, w, v = self.inputs, self.w0, self.w, self.v
        at = np.full(1 << BITS, -1, np.int32)
        at[inputs] = np.arange(len(inputs), dtype=np.int32)

        def score(texts: list[str]) -> np.ndarray:
            z = np.full(len(texts), w0)
            for k, text in enumerate(texts):
                i = at[terms(text)]
                if len(i := i[i >= 0]):
                    vi = v[i]
                    z[k] += w[i].sum() + 0.5 * ((vi.sum(0) ** 2).sum() - (vi**2).sum())
            return 1 / (1 + np.exp(-np.clip(z, -35, 35)))

        return score


def lazily(model):
    """A scorer whose tables are built in the task that uses it, so that only the weights travel."""
    held = []

    def score(texts):
        if not held:
            held.append(model.scorer())
        return held[0](texts)

    return score


def marginal(df: np.ndarray, df1: np.ndarray, n: int, n1: int) -> np.ndarray:
    """By how many standard errors a term's share differs between both classes."""
    p = df / n
    return np.abs(df1 / n1 - (df - df1) / (n - n1)) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / (n - n1)))


def joint(rows: list[np.ndarray], y: np.ndarray, width: int) -> np.ndarray:
    """The terms, of ``width``, in some pair whose share of label 1 is not what its terms give apart.

    The contrast of the four cells (both terms, either one, none) is zero for additive terms; it is taken for all pairs,
    a square of ``SIDE`` terms at a time.
    """
    n, p, total = len(y), y.mean(), y.sum()
    row, col = np.repeat(np.arange(n), [len(r) for r in rows]), np.concatenate(rows)
    c, s = np.bincount(col, minlength=width).astype(np.float32), np.bincount(col, y[row], width).astype(np.float32)
    on = np.zeros(width, bool)

    def square(first: int) -> np.ndarray:
        """The columns of one side: one 0 or 1 per row."""
        here = (col >= first) & (col < first + SIDE)
        x = np.zeros((n, min(SIDE, width - first)), np.float32)
        x[row[here], col[here] - first] = 1
        return x

    for i in range(0, width, SIDE):
        left = square(i)
        toxic = left * y[:, None].astype(np.float32)
        for j in range(i, width, SIDE):
            a, b, right = slice(i, i + SIDE), slice(j, j + SIDE), square(j)
            c11, s11 = left.T @ right, toxic.T @ right
            c10, s10, c01, s01 = c[a][:, None] - c11, s[a][:, None] - s11, c[b][None] - c11, s[b][None] - s11
            c00, s00 = n - c11 - c10 - c01, total - s11 - s10 - s01
            cells = ((c11, s11, 1), (c10, s10, -1), (c01, s01, -1), (c00, s00, 1))
            contrast = sum(sign * q / np.maximum(k, 1) for k, q, sign in cells)
            z = np.abs(contrast) / np.sqrt(p * (1 - p) * sum(1 / np.maximum(k, 1) for k, _, _ in cells))
            hit = (z >= JOINT) & (np.minimum(np.minimum(c11, c10), np.minimum(c01, c00)) >= 8)
            on[a] |= hit.any(1)
            on[b] |= hit.any(0)
    return on


def fit(found: list[np.ndarray], y: np.ndarray) -> Machine:
    """Picks the inputs and fits the machine by Adagrad on the logistic loss, over the inputs that a batch touches."""
    n1, n = int(y.sum()), len(y)
    prior = n1 / n if n else 0.0
    if not 0 < n1 < n:
        return Machine(np.zeros(0, np.int64), float(np.log((prior + 1e-9) / (1 - prior + 1e-9))), np.zeros(0), np.zeros((0, FACTORS)))
    flat, row = np.concatenate(found), np.repeat(np.arange(n), [len(x) for x in found])
    df = np.bincount(flat, minlength=1 << BITS)
    df1 = np.bincount(flat[y[row] == 1], minlength=1 << BITS)
    use = (marginal(df, df1, n, n1) >= Z) & (df >= 3)
    at = np.full(1 << BITS, -1)

    def kept(inputs: np.ndarray) -> list[np.ndarray]:
        at[:] = -1
        at[inputs] = np.arange(len(inputs))
        return [(i := at[x])[i >= 0] for x in found]

    common = np.flatnonzero((df >= np.maximum(8, n * SHARE)) & (df < n))
    use[common[joint(kept(common), y, len(common))]] = True
    inputs = np.flatnonzero(use)
    rows = kept(inputs)
    rng = np.random.default_rng(11)
    w0, w, v = float(np.log(prior / (1 - prior))), np.zeros(len(inputs)), rng.normal(0, 0.01, (len(inputs), FACTORS))
    g0, gw, gv = 1e-8, np.full_like(w, 1e-8), np.full_like(v, 1e-8)
    batches = max(1, n // BATCH)
    for _ in range(-(-STEPS // batches) if len(inputs) else 0):  # as many steps on a small sample as on a large one
        for part in np.array_split(rng.permutation(n), batches):
            mine = [rows[i] for i in part]
            used, col = np.unique(np.concatenate(mine), return_inverse=True)
            x = np.zeros((len(part), len(used)))
            x[np.repeat(np.arange(len(part)), [len(r) for r in mine]), col] = 1
            wb, vb = w[used], v[used]
            s = x @ vb
            out = w0 + x @ wb + 0.5 * ((s**2).sum(1) - x @ (vb**2).sum(1))
            e = (1 / (1 + np.exp(-np.clip(out, -35, 35))) - y[part]) / len(part)
            xe = x.T @ e
            d0, dw = e.sum(), xe + DECAY * wb / len(part)
            dv = x.T @ (e[:, None] * s) - xe[:, None] * vb + DECAY * vb / len(part)
            g0 += d0**2
            gw[used] += dw**2
            gv[used] += dv**2
            w0 -= RATE * d0 / np.sqrt(g0)
            w[used] -= RATE * dw / np.sqrt(gw[used])
            v[used] -= RATE * dv / np.sqrt(gv[used])
    return Machine(inputs, float(w0), w, v)


def train(docs: DataFrame, labels: DataFrame, limit: int = LIMIT) -> Machine:
    return Machine(**fitted(sample(docs, labels, "toxic", limit), terms, lambda found, y: vars(fit(found, y))))


def score(docs: DataFrame, model: Machine) -> DataFrame:
    return scored(docs, lazily(model), 0.5)


def clean(docs: DataFrame, model: Machine, threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold."""
    return passing(docs, lazily(model), lambda s: s < threshold)


def op2_toxicity(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
