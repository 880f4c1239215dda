"""Gradient-boosted binary trees on small dense feature tables, with monotone calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete trees of one depth: feature and split per inner node, value per leaf."""

    feature: np.ndarray
    split: np.ndarray
    leaf: np.ndarray
    base: float
    #: Calibration: raw scores and the chance of a true case up to each.
    knots: np.ndarray
    chance: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        depth = int(np.log2(self.leaf.shape[1]))
        for f, s, leaf in zip(self.feature, self.split, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[np.arange(len(x)), f[at]] > s[at])
            out += leaf[at - (len(f))]
        return out

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Calibrated chance of a true case."""
        return np.interp(self.raw(x), self.knots, self.chance)


def _monotone(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators over held-out scores, drawn towards a half by one case each way."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []
    for s, t in zip(score[order], y[order], strict=True):
        pools.append([float(t), 1.0, float(s)])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            a = pools.pop()
            pools[-1] = [pools[-1][0] + a[0], pools[-1][1] + a[1], a[2]]
    return np.array([p[2] for p in pools]), np.maximum.accumulate(np.array([(p[0] + 0.5) / (p[1] + 1) for p in pools]))


def boost(x: np.ndarray, y: np.ndarray, held_x: np.ndarray, held_y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0) -> Trees:
    """Logistic boosting with second-order leaf values; splits at quantiles; calibrated on the held-out rows."""
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(d)]
    binned = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    score = np.full(n, base)
    inner, leaves = 2**depth - 1, 2**depth
    features, splits, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        f, s, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            best = (1e-9, 0, np.inf)
            if len(rows) >= 8:
                total_g, total_h = g[rows].sum(), h[rows].sum()
                own = total_g**2 / (total_h + l2)
                for k in range(d):
                    if not len(cuts[k]):
                        continue
                    b = binned[rows, k]
                    cg = np.cumsum(np.bincount(b, g[rows], len(cuts[k]) + 1))[:-1]
                    ch = np.cumsum(np.bincount(b, h[rows], len(cuts[k]) + 1))[:-1]
                    gain = cg**2 / (ch + l2) + (total_g - cg) ** 2 / (total_h - ch + l2) - own
                    if (top := int(gain.argmax())) >= 0 and gain[top] > best[0]:
                        best = float(gain[top]), k, float(cuts[k][top])
            f[node], s[node] = best[1], best[2]
            at[rows] = 2 * node + 1 + (x[rows, f[node]] > s[node])
        at -= inner
        leaf = rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + l2)
        score += leaf[at]
        features.append(f)
        splits.append(s)
        values.append(leaf)
    out = Trees(np.array(features), np.array(splits), np.array(values), base, np.array([0.0]), np.array([0.5]))
    out.knots, out.chance = _monotone(out.raw(held_x), held_y)
    return out


def threshold(chance: np.ndarray, y: np.ndarray, precision: float) -> float:
    """Least chance from which on held-out cases are true at the wanted precision; above one if there is none."""
    for t in np.unique(chance):
        if (took := chance >= t).any() and y[took].mean() >= precision:
            return float(t)
    return 1.1
