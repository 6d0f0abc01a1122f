"""Gradient-boosted regression trees for a binary target (logistic loss) on binned features, in numpy."""

from __future__ import annotations

import numpy as np

BINS = 32


def _bins_of(x: np.ndarray) -> list[np.ndarray]:
    return [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="nearest")) for j in range(x.shape[1])]


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 5, rate: float = 0.25, least: float = 2.0, l2: float = 1.0) -> dict:
    """Level-wise trees of full depth; each holds feature, threshold and leaf value arrays."""
    edges = _bins_of(x)
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1).astype(np.int64)
    m, width = x.shape
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    raw = np.full(m, base)
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(m, np.int64)
        feature, threshold = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            k = 2**level
            best, where = np.full(k, 1e-9), np.zeros((k, 2), np.int64)
            gn, hn = np.bincount(node, g, k), np.bincount(node, h, k)
            whole = gn * gn / (hn + l2)
            for j in range(width):
                if not len(edges[j]):
                    continue
                cell = node * BINS + binned[:, j]
                gl = np.bincount(cell, g, k * BINS).reshape(k, BINS).cumsum(1)[:, : len(edges[j])]
                hl = np.bincount(cell, h, k * BINS).reshape(k, BINS).cumsum(1)[:, : len(edges[j])]
                gr, hr = gn[:, None] - gl, hn[:, None] - hl
                gain = gl * gl / (hl + l2) + gr * gr / (hr + l2) - whole[:, None]
                gain[(hl < least) | (hr < least)] = 0
                cut = gain.argmax(1)
                better = gain[np.arange(k), cut] > best
                best[better] = gain[np.arange(k), cut][better]
                where[better] = np.stack([np.full(k, j), cut], 1)[better]
            split = best > 1e-9
            at = k - 1 + np.arange(k)
            feature[at] = np.where(split, where[:, 0], 0)
            threshold[at] = [edges[f][c] if s else np.inf for (f, c), s in zip(where, split, strict=True)]
            node = 2 * node + (x[np.arange(m), feature[k - 1 + node]] > threshold[k - 1 + node])
        leaf = -rate * np.bincount(node, g, 2**depth) / (np.bincount(node, h, 2**depth) + l2)
        raw += leaf[node]
        features.append(feature), thresholds.append(threshold), leaves.append(leaf)
    return {"base": base, "depth": depth, "feature": np.array(features), "threshold": np.array(thresholds, np.float32), "leaf": np.array(leaves)}


def log_odds(model: dict, x: np.ndarray) -> np.ndarray:
    out = np.full(len(x), model["base"])
    rows = np.arange(len(x))
    for feature, threshold, leaf in zip(model["feature"], model["threshold"], model["leaf"], strict=True):
        node = np.zeros(len(x), np.int64)
        for _ in range(model["depth"]):
            node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
        out += leaf[node - (2 ** model["depth"] - 1)]
    return out
