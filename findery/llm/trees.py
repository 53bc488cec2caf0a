"""Gradient-boosted trees: a small trainer for bounded samples, and trees as Spark expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Boosted:
    """Trees as nested (feature, threshold, low, high) with leaf values, and the calibration of their sum."""

    names: list[str]
    base: float
    trees: list
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        def grown(node, rows: np.ndarray) -> None:
            if isinstance(node, tuple):
                low = x[rows, node[0]] <= node[1]
                grown(node[2], rows[low])
                grown(node[3], rows[~low])
            else:
                out[rows] += node

        out = np.full(len(x), self.base)
        for t in self.trees:
            grown(t, np.arange(len(x)))
        return out

    def column(self, feature) -> Column:
        """The calibrated probability, where ``feature(name)`` gives a feature's column."""

        def grown(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            return F.when(feature(self.names[node[0]]) <= float(node[1]), grown(node[2])).otherwise(grown(node[3]))

        total = F.lit(self.base)
        for t in self.trees:
            total = total + grown(t)
        return 1 / (1 + F.exp(-(total * self.slope + self.shift)))


def boost(names: list[str], x: np.ndarray, y: np.ndarray, held: np.ndarray, rounds: int = 24, depth: int = 3, rate: float = 0.3) -> Boosted:
    """Trees by second-order boosting of the logistic loss; the rows ``held`` (a mask) calibrate slope and shift instead."""
    fit_x, fit_y = x[~held], y[~held]
    base = float(np.log((fit_y.sum() + 1) / ((1 - fit_y).sum() + 1)))
    model, total = Boosted(names, base, []), np.full(len(fit_y), base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        tree = _grow(fit_x, p - fit_y, p * (1 - p), np.arange(len(fit_y)), depth, rate)
        model.trees.append(tree)
        total += Boosted(names, 0.0, [tree]).raw(fit_x)
    if held.any():
        raw, t = model.raw(x[held]), y[held]
        a, b = 1.0, 0.0
        for _ in range(200):  # Platt's scaling by gradient steps, held to slopes up to 1: never surer than boosted
            p = 1 / (1 + np.exp(-(a * raw + b)))
            a -= 0.05 * float(((p - t) * raw).mean())
            b -= 0.05 * float((p - t).mean())
        model.slope, model.shift = min(max(a, 0.1), 1.0), b
    return model


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, rate: float):
    """The split of most gain over all features and cuts, or a leaf."""
    gain, best = 1e-6, None
    whole = g[rows].sum() ** 2 / (h[rows].sum() + 1)
    for f in range(x.shape[1]) if depth else ():
        order = rows[np.argsort(x[rows, f], kind="stable")]
        value, left_g, left_h = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
        cut = np.flatnonzero(value[1:] > value[:-1])
        if len(cut):
            right_g, right_h = left_g[-1] - left_g[cut], left_h[-1] - left_h[cut]
            gains = left_g[cut] ** 2 / (left_h[cut] + 1) + right_g**2 / (right_h + 1) - whole
            k = int(np.argmax(gains))
            if gains[k] > gain:
                gain, best = gains[k], (f, float((value[cut[k]] + value[cut[k] + 1]) / 2))
    if best is None:
        return float(-rate * g[rows].sum() / (h[rows].sum() + 1))
    low = x[rows, best[0]] <= best[1]
    return (*best, _grow(x, g, h, rows[low], depth - 1, rate), _grow(x, g, h, rows[~low], depth - 1, rate))
