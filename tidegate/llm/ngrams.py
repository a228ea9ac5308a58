"""Hashed byte trigrams of whole texts and linear models over them.

A text's features are how often each hashed trigram of its bytes stands in it, over the number of its trigrams.  A linear
score is then the mean weight of its trigrams, so scoring needs one table look-up per byte and no vectors.
"""

from __future__ import annotations

import numpy as np

BITS = 12
SIZE = 1 << BITS
#: Weights are held in units of 2^-24.
UNIT = float(1 << 24)


def codes(data: np.ndarray) -> np.ndarray:
    """Hashed trigram that starts at each byte but the last two."""
    d = data.astype(np.uint32)
    c = d[:-2] | (d[1:-1] << np.uint32(8)) | (d[2:] << np.uint32(16))
    return ((c * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int32)


def _spans(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of each row: (first, how many)."""
    return offsets[:-1], np.maximum(np.diff(offsets) - 2, 0)


def counts(offsets: np.ndarray, data: np.ndarray) -> list[np.ndarray]:
    """Counts of all hashed trigrams, for each row."""
    c = codes(data) if len(data) > 2 else np.zeros(0, np.int32)
    return [np.bincount(c[s: s + n], minlength=SIZE) for s, n in zip(*_spans(offsets))]


def scores(offsets: np.ndarray, data: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """(rows, models) linear scores; a text of fewer than three bytes has the bias alone.

    Weights are whole numbers (``whole``), so that sums do not depend on how rows fall into blocks.
    """
    first, n = _spans(offsets)
    out = np.zeros((len(n), len(weights)))
    if len(data) > 2:
        c = codes(data)
        for k, w in enumerate(weights):
            sums = np.zeros(len(c) + 1, np.int64)
            np.cumsum(w[c], out=sums[1:])
            low = np.minimum(first, len(c))
            out[:, k] = sums[np.minimum(low + n, len(c))] - sums[low]
    return out / np.maximum(n, 1)[:, None] / UNIT + bias


def whole(weights: np.ndarray) -> np.ndarray:
    return np.round(weights * UNIT).astype(np.int64)


def fit(rows: np.ndarray, target: np.ndarray, weight: np.ndarray, loss: str, rounds: int = 300,
        decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """(weights, bias) by Adam on a squared hinge (``target`` -1 or 1) or logistic loss (``target`` 0 to 1).

    ``rows`` are relative frequencies; they are scaled by each feature's root mean square for the fit.
    """
    scale = 1 / np.sqrt((rows ** 2).mean(axis=0) + 1e-8)
    x = (rows * scale).astype(np.float32) / np.sqrt(rows.shape[1])
    theta = np.zeros(rows.shape[1] + 1)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    weight = weight / weight.sum()
    for k in range(1, rounds + 1):
        z = x @ theta[:-1].astype(np.float32) + theta[-1]
        if loss == "hinge":
            slope = -2 * target * np.maximum(0, 1 - target * z)
        else:
            slope = 1 / (1 + np.exp(-z)) - target
        g = weight * slope
        grad = np.append(x.T @ g.astype(np.float32) + decay * theta[:-1], g.sum())
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad ** 2
        theta -= 0.1 * (first / (1 - 0.9 ** k)) / (np.sqrt(second / (1 - 0.999 ** k)) + 1e-9)
    return theta[:-1] * scale / np.sqrt(rows.shape[1]), float(theta[-1])
