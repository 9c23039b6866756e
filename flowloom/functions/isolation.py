"""Isolation forests: fitted on a small reference sample, scored as tables of nodes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from flowloom.functions import trees
from flowloom.functions.trees import Forest


def _expected(n: int) -> float:
    """Mean depth of a failed search among n points."""
    return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)


def fit(sample: np.ndarray, columns: Sequence[str], n_trees: int = 20, contamination: float = 0.01, seed: int = 42) -> Forest:
    """A forest on a sample of a few hundred rows, whose result (minus the anomaly score, moved) lies below zero for the share `contamination` of it."""
    rng, most = np.random.default_rng(seed), int(np.ceil(np.log2(max(len(sample), 2))))
    out = Forest(list(columns), scale=float(_expected(len(sample))))

    def grow(rows: np.ndarray, level: int) -> int:
        me = out.leaf(level + _expected(len(rows)), level)
        low, high = rows.min(0), rows.max(0)
        wide = np.flatnonzero(high > low)
        if level < most and len(rows) > 1 and len(wide):
            f = int(rng.choice(wide))
            cut = float(rng.uniform(low[f], high[f]))
            below = rows[:, f] < cut
            if below.any() and not below.all():
                out.feature[me], out.limit[me] = f, cut
                out.left[me], out.right[me] = grow(rows[below], level + 1), grow(rows[~below], level + 1)
        return me

    for _ in range(n_trees):
        out.roots.append(grow(sample[rng.choice(len(sample), min(256, len(sample)), replace=False)], 0))
    out.offset = float(np.quantile(-np.exp2(-out.mean(sample) / out.scale), contamination))
    return out


def uniform(ranges: Sequence[tuple[float, float]], n: int = 150, seed: int = 42) -> np.ndarray:
    """A reference sample of harmless traffic: each feature uniform in its range."""
    low, high = np.array(ranges, float).T
    return np.random.default_rng(seed).uniform(low, high, (n, len(ranges)))


def with_decision(df: DataFrame, forest: Forest, name: str = "decision") -> DataFrame:
    """Adds the forest's result: below zero for outliers."""
    return trees.with_result(df, forest, name)
