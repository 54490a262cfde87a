"""Linear-chain conditional random fields with two labels, vectorized over many chains.

A chain's score is the sum of y_t * u_t (u: the node potential of label 1 against label 0) and of
A[y_(t-1), y_t]. Messages are kept as log ratios of label 1 to label 0, so nothing under- or
overflows on long chains.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def layout(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chains from the longest: start offsets in the flat array, lengths, and how many are alive at each step."""
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    order = np.argsort(-lengths, kind="stable")
    longest = int(lengths.max(initial=0))
    alive = np.searchsorted(-lengths[order], -np.arange(longest), side="left")
    return starts[order], lengths[order], alive


def _messages(u: np.ndarray, lengths: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward log ratios (node included) and backward log ratios (node not included), flat like u."""
    starts, lens, alive = layout(lengths)
    forward, backward = np.empty_like(u), np.zeros_like(u)
    r = u[starts[: alive[0]]] if len(alive) else u[:0]
    if len(alive):
        forward[starts[: alive[0]]] = r
    for t in range(1, len(alive)):
        n = alive[t]
        r = r[:n]
        at = starts[:n] + t
        r = u[at] + np.logaddexp(a[0, 1], a[1, 1] + r) - np.logaddexp(a[0, 0], a[1, 0] + r)
        forward[at] = r
    for t in range(len(alive) - 2, -1, -1):
        n = alive[t + 1]
        at = starts[:n] + t
        s = u[at + 1] + backward[at + 1]
        backward[at] = np.logaddexp(a[1, 0], a[1, 1] + s) - np.logaddexp(a[0, 0], a[0, 1] + s)
    return forward, backward


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def marginals(u: np.ndarray, lengths: np.ndarray, a: np.ndarray) -> np.ndarray:
    """P(y_t = 1 | chain), by forward-backward, flat like u."""
    f, b = _messages(np.asarray(u, float), np.asarray(lengths, np.int64), a)
    return sigmoid(f + b)


def viterbi(u: Sequence[float], a: np.ndarray) -> list[int]:
    """The best labelling of one chain; ties go to label 1."""
    if not len(u):
        return []
    (a00, a01), (a10, a11) = a.tolist()
    s0, s1, back = 0.0, float(u[0]), []
    for x in u[1:]:
        b0, b1 = s1 + a10 >= s0 + a00, s1 + a11 >= s0 + a01
        s0, s1 = (s1 + a10 if b0 else s0 + a00), float(x) + (s1 + a11 if b1 else s0 + a01)
        back.append((b0, b1))
    y = [int(s1 >= s0)]
    for b0, b1 in reversed(back):
        y.append(int(b1 if y[-1] else b0))
    return y[::-1]


def _inner(lengths: np.ndarray) -> np.ndarray:
    """The flat places that have a predecessor in their chain."""
    first = np.zeros(int(lengths.sum()), bool)
    first[np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)[: len(lengths)]] = True
    return np.flatnonzero(~first)


def gradient(u: np.ndarray, labels: np.ndarray, lengths: np.ndarray, a: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of the log likelihood by node potentials (flat) and by transitions [2, 2]: what is observed less what is expected.

    weight: importance of each chain, given at each of its positions.
    """
    f, b = _messages(u, lengths, a)
    nodes = labels - sigmoid(f + b)
    to = _inner(lengths)
    before, here = f[to - 1], u[to] + b[to]
    score = np.stack([np.full(len(to), a[0, 0]), a[0, 1] + here, a[1, 0] + before, a[1, 1] + before + here])
    score = np.exp(score - score.max(axis=0, initial=-np.inf)) if len(to) else score
    expected = score / score.sum(axis=0) if len(to) else score
    observed = np.zeros_like(expected)
    observed[(2 * labels[to - 1] + labels[to]).astype(np.int64), np.arange(len(to))] = 1
    pairs = observed - expected
    if weight is not None:
        nodes, pairs = nodes * weight, pairs * weight[to]
    return nodes, pairs.sum(axis=1).reshape(2, 2)


def train(features: np.ndarray, labels: np.ndarray, lengths: np.ndarray, n_features: int, epochs: int = 40, rate: float = 0.5, l2: float = 1e-4, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights [n_features] and transitions [2, 2], by full-batch gradient ascent with adaptive, shrinking steps.

    features: [positions, slots] ids, 0 for none; labels: 0/1 a position; chains lie one after another.
    The transitions start from the labels' smoothed frequencies and are fitted along with the weights.
    weight: importance of each chain, given at each of its positions.
    """
    features, labels, lengths = np.asarray(features), np.asarray(labels, float), np.asarray(lengths, np.int64)
    lengths = lengths[lengths > 0]
    to = _inner(lengths)
    seen = np.ones((2, 2))
    np.add.at(seen, (labels[to - 1].astype(int), labels[to].astype(int)), 1)
    a = np.log(seen / seen.sum(axis=1, keepdims=True))
    flat, n = features.ravel(), n_features
    x, mean, square = np.concatenate([np.zeros(n), a.ravel()]), np.zeros(n + 4), np.zeros(n + 4)
    scale = 1 / max(1, len(labels))
    for k in range(epochs):
        x[0] = 0.0
        g, ga = gradient(x[:n][features].sum(axis=1), labels, lengths, x[n:].reshape(2, 2), weight)
        grad = np.concatenate([np.bincount(flat, weights=np.repeat(g, features.shape[1]), minlength=n) - l2 * x[:n], ga.ravel()]) * scale
        mean += 0.1 * (grad - mean)
        square += 0.05 * (grad * grad - square)
        step = (mean / (1 - 0.9 ** (k + 1))) / (np.sqrt(square / (1 - 0.95 ** (k + 1))) + 1e-9)
        x += rate * (1 - k / epochs) * step
    x[0] = 0.0
    return x[:n], x[n:].reshape(2, 2)
