"""Gradient-boosted symmetric trees for a two-class problem, in numpy."""

from __future__ import annotations

import numpy as np


def edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Cut points of each feature: its distinct quantiles."""
    return [np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1])) for col in x.T]


def train(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> dict:
    """Logistic loss, Newton steps. All nodes of a tree's level share one split: the one with the largest gain in total."""
    cuts = edges(x, bins)
    binned = np.stack([np.searchsorted(c, col, "left") for c, col in zip(cuts, x.T, strict=True)], 1)
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    score, model = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        leaf, splits = np.zeros(len(y), np.int64), []
        for level in range(depth):
            best = (-1.0, 0, 0)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                n, key = len(c) + 1, leaf * (len(c) + 1) + binned[:, f]
                size = n << level
                sg = np.bincount(key, g, size).reshape(-1, n).cumsum(1)
                sh = np.bincount(key, h, size).reshape(-1, n).cumsum(1)
                left = sg[:, :-1] ** 2 / (sh[:, :-1] + ridge)
                right = (sg[:, -1:] - sg[:, :-1]) ** 2 / (sh[:, -1:] - sh[:, :-1] + ridge)
                gain = (left + right).sum(0)
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (float(gain[at]), f, at)
            _, f, at = best
            splits.append((f, float(cuts[f][at])))
            leaf |= (binned[:, f] > at).astype(np.int64) << level
        value = rate * np.bincount(leaf, g, 1 << depth) / (np.bincount(leaf, h, 1 << depth) + ridge)
        score += value[leaf]
        model.append({"splits": splits, "values": [round(float(v), 5) for v in value]})
    return {"base": base, "trees": model}


def logits(model: dict, x: np.ndarray) -> np.ndarray:
    out = np.full(len(x), model["base"])
    for tree in model["trees"]:
        leaf = np.zeros(len(x), np.int64)
        for level, (f, t) in enumerate(tree["splits"]):
            leaf |= (x[:, f] > t).astype(np.int64) << level
        out += np.asarray(tree["values"])[leaf]
    return out
