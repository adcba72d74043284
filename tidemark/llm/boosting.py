"""Small gradient-boosted trees on features in fixed bins.

`fit` needs only sums over the examples: gradients per (node, feature, bin) for every level of a tree.  They come from
a few thousand distinct examples in memory or from a pass over a table of them; sums are whole numbers, so both give the same trees.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

# Upper ends of the bins: single counts first, then the sizes that separate parts of addresses, years and long numbers.
EDGES = np.array([-0.5, *(i + 0.5 for i in range(41)), 47.5, 63.5, 79.5, 99.5, 127.5, 199.5, 255.5, 299.5, 399.5, 599.5, 999.5,
                  1899.5, 2099.5, 9999.5, 99999.5])
BINS = len(EDGES) + 1
UNIT = 1 << 20  # gradients are summed in whole parts of this size


@dataclass(frozen=True)
class Tree:
    """A full binary tree by levels: feature and cut of inner nodes, values of leaves."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def value(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(int(np.log2(len(self.leaf)))):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.feature[node]] > self.cut[node])
        return self.leaf[node - len(self.feature)]


@dataclass(frozen=True)
class Boosted:
    """Logistic loss; `margin` is the log-odds of the positive class."""

    start: float
    trees: tuple[Tree, ...]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((t.value(x) for t in self.trees), np.zeros(len(x)))


def binned(x: np.ndarray) -> np.ndarray:
    return np.searchsorted(EDGES, x).astype(np.uint8)


def level_sums(bins: np.ndarray, y: np.ndarray, n: np.ndarray, margin: np.ndarray, begun: Tree, level: int) -> np.ndarray:
    """Gradients and curvatures per (node of the level, feature, bin) of the tree `begun`, of `n` equal examples each with margins so far; trees cut bins."""
    features = bins.shape[1]
    p = 1 / (1 + np.exp(-margin))
    node = np.zeros(len(bins), np.int64)
    for _ in range(level):
        node = 2 * node + 1 + (bins[np.arange(len(bins)), begun.feature[node]] > begun.cut[node])
    size = (1 << level) * features * BINS
    key = (((node - (1 << level) + 1)[:, None] * features + np.arange(features)) * BINS + bins).ravel()
    # Whole numbers in doubles: exact up to 2^53, which is 2^33 examples.
    whole = (np.rint(v * UNIT) * n for v in (y - p, np.maximum(p * (1 - p), 1e-6)))
    return np.stack([np.bincount(key, np.repeat(v, features), size) for v in whole]).astype(np.int64)


def sums_of(bins: np.ndarray, y: np.ndarray, n: np.ndarray) -> Callable[[Boosted, Tree, int], np.ndarray]:
    """`level_sums` of examples in memory; margins are carried on from tree to tree."""
    done, margin = 0, None

    def sums(model: Boosted, begun: Tree, level: int) -> np.ndarray:
        nonlocal done, margin
        if margin is None:
            margin = np.full(len(bins), model.start)
        for tree in model.trees[done:]:
            margin = margin + tree.value(bins)
        done = len(model.trees)
        return level_sums(bins, y, n, margin, begun, level)

    return sums


def fit(total: int, positive: int, features: int, sums: Callable[[Boosted, Tree, int], np.ndarray],
        rounds: int = 40, depth: int = 4, rate: float = 0.2, shrink: float = 2.0) -> Boosted:
    """Newton boosting with histogram splits; `sums` adds up `level_sums` over all examples.  The trees cut bins."""
    share = np.clip(positive / total, 1e-3, 1 - 1e-3)
    model = Boosted(float(np.log(share / (1 - share))), ())
    inner = (1 << depth) - 1
    for _ in range(rounds):
        tree = Tree(np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(1 << depth))
        for level in range(depth):
            base, width = (1 << level) - 1, 1 << level
            g, h = (v.reshape(width, features, BINS).cumsum(axis=2) / UNIT for v in sums(model, tree, level))
            g_all, h_all = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + shrink) + (g_all - g)**2 / (h_all - h + shrink) - g_all**2 / (h_all + shrink)
            for k in range(width):
                f, b = np.unravel_index(np.argmax(gain[k]), gain[k].shape)
                split = gain[k, f, b] > 1e-9 and b < len(EDGES)
                if split:
                    tree.feature[base + k], tree.cut[base + k] = f, b
                if level == depth - 1:  # without a split all examples go left
                    left = (g[k, f, b], h[k, f, b]) if split else (g_all[k, 0, 0], h_all[k, 0, 0])
                    tree.leaf[2 * k] = rate * left[0] / (left[1] + shrink)
                    tree.leaf[2 * k + 1] = rate * (g_all[k, 0, 0] - left[0]) / (h_all[k, 0, 0] - left[1] + shrink)
        model = Boosted(model.start, (*model.trees, tree))
    return model


def on_values(model: Boosted) -> Boosted:
    """The same trees with cuts on values instead of bins."""
    ends = np.append(EDGES, np.inf)
    return Boosted(model.start, tuple(Tree(t.feature, ends[np.minimum(t.cut, len(EDGES)).astype(int)], t.leaf) for t in model.trees))
