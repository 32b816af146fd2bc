"""Forests on alike rows within one task, for searches that need very many of them.

The method is that of MLlib's ``RandomForestClassifier``: bootstrap draws, a random subset of the features for every node, Gini
gain on binned features, level by level. A row with weight n stands for n rows alike in their bins and label, so it is
drawn Poisson(n) times, as those rows would be one by one. A tree cut at a depth is a tree of that depth, so all depths
come from one growth; held-out rows go down each tree as it grows.
"""

from __future__ import annotations

import numpy as np

# Nodes whose histograms are made at once.
NODES = 2048


def best_splits(
    rows: np.ndarray, label: np.ndarray, weight: np.ndarray, at: np.ndarray, counts: np.ndarray, chosen: np.ndarray, width: int, least: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every node: whether it splits, by which feature, and the last bin that goes left."""
    nodes, classes = counts.shape
    tried = chosen.shape[1]
    splits, feature, cut = np.zeros(nodes, bool), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
    order = np.argsort(at, kind="stable")
    starts = np.searchsorted(at[order], np.arange(0, nodes + NODES, NODES))
    for k, first in enumerate(range(0, nodes, NODES)):
        own = order[starts[k] : starts[k + 1]]
        here, size = at[own] - first, min(NODES, nodes - first)
        bins = rows[own[:, None], chosen[at[own]]]
        cells = (((here[:, None] * tried + np.arange(tried)) * width + bins) * classes + label[own, None]).ravel()
        left = np.bincount(cells, np.repeat(weight[own], tried), size * tried * width * classes)
        left = left.reshape(size, tried, width, classes).cumsum(axis=2)
        whole = counts[first : first + size, None, None, :]
        right = whole - left
        left_n, right_n, whole_n = left.sum(axis=3), right.sum(axis=3), whole.sum(axis=3)
        pure = (left**2).sum(axis=3) / np.maximum(left_n, 1) + (right**2).sum(axis=3) / np.maximum(right_n, 1)
        gain = pure - (whole**2).sum(axis=3) / np.maximum(whole_n, 1)
        gain = np.where((left_n >= max(least, 1)) & (right_n >= max(least, 1)), gain, 0.0).reshape(size, -1)
        best = gain.argmax(axis=1)
        part, every = slice(first, first + size), np.arange(size)
        splits[part] = gain[every, best] > 1e-9 * np.maximum(whole_n[:, 0, 0], 1)
        feature[part], cut[part] = chosen[first + every, best // width], best % width
    return splits, feature, cut


def forest_votes(
    rows: np.ndarray, label: np.ndarray, weight: np.ndarray, held: np.ndarray, trees: range, depths: list[int], classes: int,
    tried: int, least: int = 1, rate: float = 1.0, seed: int = 0,
) -> np.ndarray:
    """By depth, held-out row and class: the sum over the ``trees`` of the shares of the classes where the row ends."""
    width = int(max(rows.max(initial=0), held.max(initial=0))) + 1
    votes = np.zeros((len(depths), len(held), classes), np.float32)
    for tree in trees:
        rng = np.random.default_rng((seed, tree))
        times = rng.poisson(weight * rate)
        drawn = np.flatnonzero(times)
        x, y, w, at = rows[drawn], label[drawn], times[drawn].astype(float), np.zeros(len(drawn), np.int64)
        alive, held_at, share = np.arange(len(held)), np.zeros(len(held), np.int64), np.zeros((len(held), classes), np.float32)
        nodes = 1 if len(drawn) else 0
        for depth in range(max(depths) + 1):
            if nodes:
                counts = np.bincount(at * classes + y, w, nodes * classes).reshape(nodes, classes)
                share[alive] = (counts / counts.sum(axis=1, keepdims=True))[held_at]
            for k in np.flatnonzero(np.array(depths) == depth):
                votes[k] += share
            if nodes and depth < max(depths):
                chosen = np.argsort(rng.random((nodes, rows.shape[1])), axis=1)[:, :tried]
                splits, feature, cut = best_splits(x, y, w, at, counts, chosen, width, least)
                rank, nodes = 2 * (np.cumsum(splits) - 1), 2 * int(splits.sum())
                stays = splits[at]
                x, y, w, at = x[stays], y[stays], w[stays], at[stays]
                at = rank[at] + (x[np.arange(len(x)), feature[at]] > cut[at])
                stays = splits[held_at]
                alive, held_at = alive[stays], held_at[stays]
                held_at = rank[held_at] + (held[alive, feature[held_at]] > cut[held_at])
    return votes
