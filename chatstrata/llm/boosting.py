"""Gradient-boosted regression trees for two classes, in numpy: histograms of binned features, logistic loss."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

TREES, DEPTH, RATE, BINS = 80, 5, 0.2, 32
RIDGE, LEAST_GAIN = 1.0, 1e-6


@dataclass
class Forest:
    """Complete trees of `depth` levels: the feature and threshold of each inner node, the value of each leaf."""

    features: np.ndarray
    thresholds: np.ndarray
    values: np.ndarray
    base: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        """The log-odds of class 1."""
        total = np.full(len(rows), self.base)
        number = np.arange(len(rows))
        depth = self.features.shape[1].bit_length()
        for feature, threshold, value in zip(self.features, self.thresholds, self.values):
            at = np.zeros(len(rows), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (rows[number, feature[at]] > threshold[at])
            total += value[at - len(feature)]
        return total


def fit(rows: np.ndarray, labels: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Forest:
    """Trees fitted one after another to the gradient of the log loss, by Newton steps."""
    edges = [_edges(rows[:, f]) for f in range(rows.shape[1])]
    binned = np.stack([np.searchsorted(e, rows[:, f], "left") for f, e in enumerate(edges)], axis=1)
    width = rows.shape[1]
    rate_one = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(rate_one / (1 - rate_one)))
    score = np.full(len(rows), base)
    inner = (1 << depth) - 1
    features, thresholds = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32)
    values = np.zeros((trees, inner + 1))
    # columns of two values need one sum each, which is a product of matrices
    two = np.array([len(e) <= 1 for e in edges])
    many = np.flatnonzero(~two)
    flags, flat = binned[:, two].astype(np.float64), binned[:, many] + np.arange(len(many)) * BINS
    flagged = np.flatnonzero(two)
    for tree in range(trees):
        chance = 1 / (1 + np.exp(-score))
        slope, bend = labels - chance, chance * (1 - chance)
        at = np.zeros(len(rows), np.int64)
        for level in range(depth):
            first = (1 << level) - 1
            for node in range(first, 2 * first + 1):
                own = np.flatnonzero(at == node)
                if len(own) > 1:
                    gains = [_flag_gain(flags[own], slope[own], bend[own]), _bin_gain(flat[own], slope[own], bend[own], len(many))]
                    kind = int(max(g.max(initial=0) for g in gains) == gains[1].max(initial=0))
                    best = int(np.argmax(gains[kind])) if gains[kind].size else 0
                    if gains[kind].max(initial=0) > LEAST_GAIN:
                        feature, cut = (flagged[best], 0) if kind == 0 else (many[best // BINS], best % BINS)
                        if cut < len(edges[feature]):
                            features[tree, node], thresholds[tree, node] = feature, edges[feature][cut]
                at[own] = 2 * node + 1 + (rows[own, features[tree, node]] > thresholds[tree, node])
        leaf = at - inner
        up, down = (np.bincount(leaf, x, inner + 1) for x in (slope, bend))
        values[tree] = rate * up / (down + RIDGE)
        score += values[tree][leaf]
    return Forest(features, thresholds, values, base)


def _edges(values: np.ndarray) -> np.ndarray:
    """Thresholds of a column: its only step if it has two values, else quantiles."""
    low, high = values.min(initial=0), values.max(initial=0)
    if not ((values > low) & (values < high)).any():
        return np.array([low]) if low < high else np.zeros(0)
    return np.unique(np.quantile(values, np.linspace(0, 1, BINS + 1)[1:-1]))


def _gain(up: np.ndarray, down: np.ndarray, whole_up: np.ndarray | float, whole_down: np.ndarray | float) -> np.ndarray:
    """What is gained where `up` and `down` are the sums of one side."""
    return up**2 / (down + RIDGE) + (whole_up - up) ** 2 / (whole_down - down + RIDGE) - whole_up**2 / (whole_down + RIDGE)


def _flag_gain(flags: np.ndarray, slope: np.ndarray, bend: np.ndarray) -> np.ndarray:
    return _gain(slope @ flags, bend @ flags, slope.sum(), bend.sum())


def _bin_gain(flat: np.ndarray, slope: np.ndarray, bend: np.ndarray, width: int) -> np.ndarray:
    """The gain of a split after each bin of each column."""
    up = np.bincount(flat.ravel(), np.repeat(slope, width), width * BINS).reshape(width, BINS).cumsum(axis=1)
    down = np.bincount(flat.ravel(), np.repeat(bend, width), width * BINS).reshape(width, BINS).cumsum(axis=1)
    return _gain(up, down, up[:, -1:], down[:, -1:])
