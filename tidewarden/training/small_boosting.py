"""Boosted trees on alike rows within one task, for searches that need very many of them.

The method is that of MLlib's ``GBTClassifier`` for two classes: least-squares trees on the gradient of the log loss, the
first with weight 1, grown level by level on histograms of binned features. MLlib runs a job for each level of each tree,
which on tens of thousands of rows is nearly all of the time. A row with weight n stands for n rows alike in their bins and
label. Rows held out go down each tree as it grows, so the accuracy after every number of rounds needs no second pass.
"""

from __future__ import annotations

import numpy as np


def tree_values(
    rows: np.ndarray, target: np.ndarray, weight: np.ndarray, held: np.ndarray, depth: int, bins: int, least: int
) -> tuple[np.ndarray, np.ndarray]:
    """What one tree, grown on the rows with a ``weight``, gives for all ``rows`` and for the ``held`` ones."""
    width = rows.shape[1]
    at, held_at, leaves = np.zeros(len(rows), np.int64), np.zeros(len(held), np.int64), 1
    offsets = np.arange(width) * bins
    drawn = np.flatnonzero(weight)
    chosen, weights = rows[drawn], weight[drawn].astype(float)
    values = target[drawn] * weights
    weights_of, values_of = np.repeat(weights, width), np.repeat(values, width)
    for _ in range(depth):
        cells = ((at[drawn] * width * bins)[:, None] + offsets + chosen).ravel()
        size = leaves * width * bins
        n = np.bincount(cells, weights_of, size).reshape(leaves, width, bins).cumsum(axis=2)
        s = np.bincount(cells, values_of, size).reshape(leaves, width, bins).cumsum(axis=2)
        whole_n, whole_s = n[:, :, -1:], s[:, :, -1:]
        gain = s**2 / np.maximum(n, 1) + (whole_s - s) ** 2 / np.maximum(whole_n - n, 1) - whole_s**2 / np.maximum(whole_n, 1)
        gain = np.where((n >= least) & (whole_n - n >= least), gain, 0.0).reshape(leaves, -1)
        best = gain.argmax(axis=1)
        splits = gain[np.arange(leaves), best] > 1e-12 * np.maximum(whole_n[:, 0, 0], 1)
        if not splits.any():
            break
        feature, cut = best // bins, best % bins
        right = np.where(splits, leaves + np.cumsum(splits) - 1, np.arange(leaves))  # a leaf stays; its left half keeps its number
        for place, table in ((at, rows), (held_at, held)):
            goes_right = table[np.arange(len(table)), feature[place]] > cut[place]
            place[:] = np.where(goes_right, right[place], place)
        leaves += int(splits.sum())
    n = np.bincount(at[drawn], weights, leaves)
    mean = np.bincount(at[drawn], values, leaves) / np.maximum(n, 1)
    return mean[at], mean[held_at]


def boosted_hits(
    rows: np.ndarray, label: np.ndarray, weight: np.ndarray, held: np.ndarray, held_label: np.ndarray, held_weight: np.ndarray,
    sizes: list[int], depth: int, step: float, least: int = 1, rate: float = 1.0, seed: int = 0,
) -> list[float]:
    """The accuracy on the held-out rows after each number of rounds in ``sizes``; rows are numbers of bins, labels 0 and 1."""
    bins = int(max(rows.max(initial=0), held.max(initial=0))) + 1
    sign, rng, found = 2.0 * label - 1.0, np.random.default_rng(seed), {}
    margin, held_margin = np.zeros(len(rows)), np.zeros(len(held))
    for done in range(1, max(sizes) + 1):
        target = sign if done == 1 else 4.0 * sign / (1.0 + np.exp(np.minimum(2.0 * sign * margin, 700.0)))
        drawn = rng.binomial(weight, rate) if rate < 1.0 else weight
        own, others = tree_values(rows, target, drawn, held, depth, bins, least)
        factor = 1.0 if done == 1 else step
        margin += factor * own
        held_margin += factor * others
        if done in sizes:
            found[done] = float(np.average((held_margin > 0) == (held_label > 0), weights=held_weight)) if len(held) else 0.0
    return [found[s] for s in sizes]
