"""A conditional random field over chains of tokens with skip edges, by loopy belief propagation.

All documents of a batch are one graph: nodes with feature rows, edges (i, j, type). Type 0 joins neighbours in the
text, the others join distant tokens that repeat or resemble each other and share one potential each. Messages go along
all edges at once, in both directions, for ``SWEEPS`` sweeps or until none changes by ``STILL``; with them each node's
belief takes in what was found elsewhere in the document. Fitting follows the likelihood's gradient, observed less
expected counts, with the expectation from the same propagation.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SWEEPS, STILL, DAMP = 20, 1e-3, 0.3
STEPS, RATE, DECAY = 120, 0.3, 2e-3
FAR = -20.0


@dataclass
class Graph:
    """x: nodes x features (0 or 1); a, b, kind: edges from the earlier to the later node; first: 1 where no neighbour
    stands before a node; known: its label where evidence fixes it, else -1."""

    x: np.ndarray
    a: np.ndarray
    b: np.ndarray
    kind: np.ndarray
    first: np.ndarray
    known: np.ndarray


@dataclass
class Field:
    """unary: features x labels; chain: labels x labels; skip: types x groups x groups; group: each label's group."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    group: np.ndarray
    opening: np.ndarray
    follows: np.ndarray

    def potentials(self, g: Graph) -> tuple[np.ndarray, np.ndarray]:
        """Log potentials of nodes, and of edge types; what may not begin or follow is far down."""
        node = g.x @ self.unary + np.where(g.first[:, None] & ~self.opening, FAR, 0.0)
        fixed = np.flatnonzero(g.known >= 0)
        node[fixed] = FAR * 2
        node[fixed, g.known[fixed]] = 0
        edge = np.stack([np.where(self.follows, self.chain, FAR), *(m[np.ix_(self.group, self.group)] for m in self.skip)])
        return node, edge

    def propagate(self, g: Graph, messages: np.ndarray | None = None, sweeps: int = SWEEPS):
        """(beliefs of nodes, of edges' ends without the edge's own message, messages): sum-product, all edges at once."""
        node, edge = self.potentials(g)
        n, labels, e = *node.shape, len(g.a)
        to = np.r_[g.b, g.a]
        order = np.argsort(to, kind="stable")
        lead = np.flatnonzero(np.r_[True, to[order][1:] != to[order][:-1]]) if e else np.zeros(0, np.int64)
        m = np.zeros((2 * e, labels)) if messages is None else messages
        spread = np.exp(edge)

        def believed():
            out = node.copy()
            if e:
                out[to[order][lead]] += np.add.reduceat(m[order], lead, 0)
            return out

        for _ in range(sweeps if e else 0):
            belief = believed()
            new = np.empty_like(m)
            for back in (0, 1):  # along the edge and against it
                source, own = (g.b, m[:e]) if back else (g.a, m[e:])
                cavity = belief[source] - own
                cavity = np.exp(cavity - cavity.max(1, keepdims=True))
                for t in range(len(edge)):
                    on = np.flatnonzero(g.kind == t)
                    new[on + back * e] = np.log(cavity[on] @ (spread[t].T if back else spread[t]) + 1e-30)
            new -= new.max(1, keepdims=True)
            new = DAMP * m + (1 - DAMP) * new
            change, m = np.abs(new - m).max(), new
            if change < STILL:
                break
        belief = believed()
        ends = (belief[g.a] - m[e:], belief[g.b] - m[:e])
        return belief, ends, m, edge

    def labels(self, g: Graph) -> np.ndarray:
        return self.propagate(g)[0].argmax(1) if len(g.x) else np.zeros(0, np.int64)


def normal(log: np.ndarray, axes) -> np.ndarray:
    p = np.exp(log - log.max(axes, keepdims=True))
    return p / p.sum(axes, keepdims=True)


def fit(g: Graph, y: np.ndarray, field: Field, steps: int = STEPS) -> Field:
    """The field whose expected counts, given the evidence, meet those of the labels ``y``; by Adagrad on the
    approximate gradient. Messages are kept from step to step, so few sweeps a step are enough."""
    labels, types = field.chain.shape[0], 1 + len(field.skip)
    seen = np.zeros((types, labels, labels))
    np.add.at(seen, (g.kind, y[g.a], y[g.b]), 1)
    want = g.x.T @ np.eye(labels)[y]
    to_groups = np.eye(field.skip.shape[1])[field.group]
    parts = [field.unary, field.chain, field.skip]
    squares, m = [np.full_like(p, 1e-8) for p in parts], None
    for _ in range(steps):
        belief, (left, right), m, edge = field.propagate(g, m, 3)
        off = seen.copy()
        for t in range(types):
            on = np.flatnonzero(g.kind == t)
            off[t] -= normal(left[on][:, :, None] + right[on][:, None, :] + edge[t], (1, 2)).sum(0)
        skip = to_groups.T @ off[1:] @ to_groups
        slopes = [want - g.x.T @ normal(belief, (1,)), np.where(field.follows, off[0], 0), (skip + skip.transpose(0, 2, 1)) / 2]
        for p, s, d in zip(parts, squares, slopes, strict=True):
            d = d / len(y) - DECAY * p / 10
            s += d**2
            p += RATE * d / np.sqrt(s)
    return field
