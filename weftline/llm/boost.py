"""Gradient-boosted trees for two classes and isotonic calibration, for samples that fit in the driver."""

from __future__ import annotations

import numpy as np

BINS = 64


class Trees:
    """Boosted regression trees of fixed depth on quantile bins; ``margin`` gives log-odds."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.15, penalty: float = 1.0) -> None:
        self.rounds, self.depth, self.rate, self.penalty = rounds, depth, rate, penalty

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Trees:
        weight = np.ones(len(y)) if weight is None else weight
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
        share = (weight @ y + 0.5) / (weight.sum() + 1.0)
        self.base = float(np.log(share / (1 - share)))
        nodes = 1 << self.depth
        self.feature, self.cut, self.leaf = [], [], []
        if not len(x) or y.min() == y.max():
            return self
        binned = np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], axis=1)
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = weight * (y - p), weight * p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros(nodes - 1, np.int64), np.full(nodes - 1, np.inf)
            for level in range(self.depth):
                n, at = 1 << level, (1 << level) - 1
                best = np.full(n, 1e-9)
                split = np.full(n, BINS)
                for j in range(x.shape[1]):
                    if not len(self.cuts[j]):
                        continue
                    key = node * BINS + binned[:, j]
                    gs = np.cumsum(np.bincount(key, g, n * BINS).reshape(n, BINS), axis=1)
                    hs = np.cumsum(np.bincount(key, h, n * BINS).reshape(n, BINS), axis=1)
                    score = lambda a, b: a * a / (b + self.penalty)
                    gain = score(gs, hs) + score(gs[:, -1:] - gs, hs[:, -1:] - hs) - score(gs[:, -1:], hs[:, -1:])
                    gain = gain[:, : len(self.cuts[j])]
                    found = gain.argmax(axis=1)
                    value = gain[np.arange(n), found]
                    better = value > best + 1e-12
                    best = np.where(better, value, best)
                    split[better] = found[better]
                    feature[at : at + n][better] = j
                    cut[at : at + n][better] = self.cuts[j][found[better]]
                node = 2 * node + (binned[np.arange(len(y)), feature[at + node]] > split[node])
            value = self.rate * np.bincount(node, g, nodes) / (np.bincount(node, h, nodes) + self.penalty)
            f = f + value[node]
            self.feature.append(feature)
            self.cut.append(cut)
            self.leaf.append(value)
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = (1 << level) - 1 + node
                node = 2 * node + (x[rows, feature[at]] >= cut[at])
            out += leaf[node]
        return out


def route(bins: np.ndarray, feature: np.ndarray, split: np.ndarray, levels: int) -> np.ndarray:
    """The node that each row of binned features reaches after ``levels`` splits."""
    node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    for level in range(levels):
        at = (1 << level) - 1 + node
        node = 2 * node + (bins[rows, feature[at]] > split[at])
    return node


def gradients(bins: np.ndarray, y: np.ndarray, weight: float, f: np.ndarray, node: np.ndarray, n: int) -> np.ndarray:
    """Sums of gradients and of second derivatives by feature, node and bin, which add up over parts of a table."""
    p = 1 / (1 + np.exp(-f))
    g, h = weight * (y - p), weight * p * (1 - p)
    out = np.empty((2, bins.shape[1], n, BINS))
    for j in range(bins.shape[1]):
        key = node * BINS + bins[:, j]
        out[0, j], out[1, j] = (np.bincount(key, v, n * BINS).reshape(n, BINS) for v in (g, h))
    return out


class WideTrees(Trees):
    """Trees whose rows may lie in many places: all that a level needs of them are sums of ``gradients``."""

    def __init__(self, cuts: list[np.ndarray], *more: float) -> None:
        super().__init__(*more)
        self.cuts = cuts
        self.start(0.0, 0.0)

    def start(self, good: float, total: float) -> None:
        share = (good + 0.5) / (total + 1.0)
        self.base, self.flat = float(np.log(share / (1 - share))), not 0 < good < total
        self.feature, self.cut, self.leaf, self.split = [], [], [], []

    def bin(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape, np.uint8)
        for j, c in enumerate(self.cuts):
            out[:, j] = np.searchsorted(c, x[:, j], side="right")
        return out

    def add_level(self, sums: np.ndarray, level: int) -> None:
        """Split the nodes of a level of the tree that grows; the last level sets its leaves."""
        nodes, n, at = 1 << self.depth, 1 << level, (1 << level) - 1
        if not level:
            self.feature.append(np.zeros(nodes - 1, np.int64))
            self.cut.append(np.full(nodes - 1, np.inf))
            self.split.append(np.full(nodes - 1, BINS))
        gs, hs = np.cumsum(sums, axis=3)
        best, score = np.full(n, 1e-9), lambda a, b: a * a / (b + self.penalty)
        for j, cuts in enumerate(self.cuts):
            if not len(cuts) or self.flat:
                continue
            g, h = gs[j], hs[j]
            gain = (score(g, h) + score(g[:, -1:] - g, h[:, -1:] - h) - score(g[:, -1:], h[:, -1:]))[:, : len(cuts)]
            found = gain.argmax(axis=1)
            value = gain[np.arange(n), found]
            better = value > best + 1e-12
            best = np.where(better, value, best)
            self.feature[-1][at : at + n][better] = j
            self.split[-1][at : at + n][better] = found[better]
            self.cut[-1][at : at + n][better] = cuts[found[better]]
        if level == self.depth - 1:
            k = np.arange(n)
            j, last = self.feature[-1][at:], np.minimum(self.split[-1][at:], BINS - 1)
            left = np.stack([gs[j, k, last], hs[j, k, last]])
            both = np.stack([left, np.stack([gs[j, k, -1], hs[j, k, -1]]) - left], axis=2).reshape(2, nodes)
            self.leaf.append(self.rate * both[0] / (both[1] + self.penalty) * (not self.flat))

    def binned_margin(self, bins: np.ndarray, done: int = 0, f: np.ndarray | None = None) -> np.ndarray:
        """Log-odds by the finished trees; ``f`` holds those of the first ``done``."""
        f = np.full(len(bins), self.base) if f is None else f
        for feature, split, leaf in list(zip(self.feature, self.split, self.leaf, strict=False))[done:]:
            f = f + leaf[route(bins, feature, split, self.depth)]
        return f

    def sums(self, bins: np.ndarray, y: np.ndarray, weight: float, f: np.ndarray, level: int) -> np.ndarray:
        node = route(bins, self.feature[-1], self.split[-1], level) if level else np.zeros(len(bins), np.int64)
        return gradients(bins, y, weight, f, node, 1 << level)


class Isotonic:
    """Monotone map from a margin to a probability by pooling adjacent violators; linear between the pools."""

    def fit(self, margin: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Isotonic:
        weight = np.ones(len(y)) if weight is None else weight
        if not len(margin):
            self.x, self.y = np.zeros(1), np.full(1, 0.5)
            return self
        order = np.lexsort((y, margin))
        xs, first = np.unique(margin[order], return_index=True)
        w = np.add.reduceat(weight[order], first)
        s = np.add.reduceat((weight * y)[order], first)
        pools: list[list[float]] = []  # sum, weight, least margin, greatest margin
        for a, b, x in zip(s.tolist(), w.tolist(), xs.tolist(), strict=True):
            pools.append([a, b, x, x])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                a2, b2, _, hi = pools.pop()
                pools[-1] = [pools[-1][0] + a2, pools[-1][1] + b2, pools[-1][2], hi]
        x, y = [], []
        for a, b, lo, hi in pools:
            p = (a + 0.01) / (b + 0.02)
            x += [lo, hi] if hi > lo else [lo]
            y += [p, p] if hi > lo else [p]
        self.x, self.y = np.array(x), np.maximum.accumulate(np.array(y))
        return self

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(margin, self.x, self.y), 0.0, 1.0)
