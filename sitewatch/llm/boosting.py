"""Gradient-boosted trees with monotonic constraints, flattened into numpy node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """All trees in one set of arrays; node i goes left if its feature is at most its threshold.

    A leaf points to itself on both sides, so every row takes ``depth`` steps in every tree.
    """

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, rows: np.ndarray, block: int = 4096) -> np.ndarray:
        """Probability of label 1 for each row of features."""
        out = np.empty(len(rows))
        for start in range(0, len(rows), block):
            x = rows[start : start + block]
            at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
            for _ in range(self.depth):
                below = np.take_along_axis(x, self.feature[at], axis=1) <= self.threshold[at]
                at = np.where(below, self.left[at], self.right[at])
            out[start : start + block] = self.base + self.value[at].sum(axis=1)
        return 1 / (1 + np.exp(-out))


def constant(probability: float) -> Trees:
    """A model without trees."""
    none = np.zeros(0, np.int64)
    p = min(max(probability, 1e-6), 1 - 1e-6)
    return Trees(none, np.zeros(0), none, none, np.zeros(0), none, 0, float(np.log(p / (1 - p))))


def fit(
    rows: np.ndarray,
    labels: np.ndarray,
    monotonic: np.ndarray,
    trees: int = 60,
    depth: int = 3,
    rate: float = 0.2,
    bins: int = 32,
    least: int = 10,
    ridge: float = 1.0,
) -> Trees:
    """Trees for 0/1 labels by Newton steps on the logistic loss.

    ``monotonic[j]`` is 1 if the score may only rise with feature j, -1 if it may only fall, 0
    if it is free. A split of a constrained feature must order its leaves that way, and whatever
    grows below either side stays on its side of the midpoint; so every tree, and their sum, is
    monotonic. Splits are searched among ``bins`` quantiles. Deterministic.
    """
    if not len(labels) or labels.min() == labels.max():
        return constant(float(labels.mean()) if len(labels) else 0.5)
    features = rows.shape[1]
    cuts = [np.unique(np.quantile(rows[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(features)]
    # Midpoints between values seen, so that scores do not hang on one value.
    binned = np.stack([np.searchsorted(c, rows[:, j]) for j, c in enumerate(cuts)], axis=1)
    share = labels.mean()
    base = float(np.log(share / (1 - share)))
    total = np.full(len(labels), base)
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots = []

    def leaf(value: float) -> int:
        at = len(nodes["value"])
        for name, x in (("feature", 0), ("threshold", 0.0), ("left", at), ("right", at), ("value", value)):
            nodes[name].append(x)
        return at

    def grow(inside: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float, level: int) -> int:
        gs, hs = g[inside], h[inside]
        at = leaf(rate * float(np.clip(gs.sum() / (hs.sum() + ridge), low, high)))
        best = (1e-9, -1, -1, 0.0, 0.0)
        if level < depth and len(inside) >= 2 * least:
            for j in range(features):
                size = len(cuts[j]) + 1
                if size == 1:
                    continue
                b = binned[inside, j]
                gl = np.cumsum(np.bincount(b, gs, size))[:-1]
                hl = np.cumsum(np.bincount(b, hs, size))[:-1]
                nl = np.cumsum(np.bincount(b, minlength=size))[:-1]
                wl = np.clip(gl / (hl + ridge), low, high)
                wr = np.clip((gs.sum() - gl) / (hs.sum() - hl + ridge), low, high)
                # Gain of two clipped leaf values over the objective without a split.
                gain = (
                    gl * wl - 0.5 * (hl + ridge) * wl**2
                    + (gs.sum() - gl) * wr - 0.5 * (hs.sum() - hl + ridge) * wr**2
                    - 0.5 * gs.sum() ** 2 / (hs.sum() + ridge)
                )
                fits = (nl >= least) & (nl <= len(inside) - least) & (monotonic[j] * (wr - wl) >= 0)
                gain = np.where(fits, gain, -np.inf)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, k, float(wl[k]), float(wr[k]))
        _, j, k, wl, wr = best
        if j >= 0:
            below = binned[inside, j] <= k
            middle = (wl + wr) / 2
            sides = [(low, high), (low, high)]
            if monotonic[j] > 0:
                sides = [(low, middle), (middle, high)]
            elif monotonic[j] < 0:
                sides = [(middle, high), (low, middle)]
            nodes["feature"][at], nodes["threshold"][at] = j, float(cuts[j][k])
            nodes["left"][at] = grow(inside[below], g, h, *sides[0], level + 1)
            nodes["right"][at] = grow(inside[~below], g, h, *sides[1], level + 1)
        return at

    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        roots.append(grow(np.arange(len(labels)), labels - p, p * (1 - p), -4.0, 4.0, 0))
        flat = Trees(
            np.array(nodes["feature"]), np.array(nodes["threshold"]), np.array(nodes["left"]),
            np.array(nodes["right"]), np.array(nodes["value"]), np.array(roots), depth, base,
        )
        last = Trees(flat.feature, flat.threshold, flat.left, flat.right, flat.value, flat.roots[-1:], depth, 0.0)
        score = last.score(rows)
        total += np.log(score / (1 - score))
    return flat
