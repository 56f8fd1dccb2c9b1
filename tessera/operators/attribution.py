"""Exact attributions of a forest's score to its features, against background rows.

The value of a set of features is the mean score of rows that have them from the row explained and the
others from a background row; a feature's attribution is its Shapley value. Along the path to a leaf,
what matters of a row is which of the path's features keep to it. For a row and a background row let a
features keep to the path by the row alone and b by the background row alone: the leaf is reached by just
the sets with all of the former and none of the latter, and gives ``(a - 1)! b! / (a + b)!`` of its value
to each of the former and ``-a! (b - 1)! / (a + b)!`` to each of the latter. So background rows are counted
by leaf and pattern once, and work grows with leaves and depth, not with subsets of features.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.model import fit_forest
from tessera.operators.prepare import stratified_folds
from tessera.plans.tables import materialise

c = F.col


@dataclass
class Leaf:
    """A leaf's part of the score, and the features on its path with the interval ``low < x <= high`` each."""

    value: float
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def patterns(self, x: np.ndarray) -> np.ndarray:
        """For each row, bit k for the path's feature k if the row keeps to the path there.

        A value that is no number goes to the right of every split.
        """
        own = x[:, self.features]
        keeps = ~(own <= self.low) & ((own <= self.high) | np.isposinf(self.high))
        return keeps @ (1 << np.arange(len(self.features), dtype=np.int64)) if len(self.features) else np.zeros(len(x), np.int64)


def leaf(value: float, bounds: dict[int, tuple[float, float]]) -> Leaf:
    features = sorted(bounds)
    return Leaf(value, np.array(features, np.int64), *(np.array([bounds[f][k] for f in features], float) for k in (0, 1)))


def forest_leaves(model) -> list[Leaf]:
    """All leaves of a Spark classification forest; their values add up to the probability of class 1."""
    out = []
    for tree in model.trees:
        stack = [(tree._call_java("rootNode"), {})]
        while stack:
            node, bounds = stack.pop()
            if node.getClass().getSimpleName() == "LeafNode":
                stats = list(node.impurityStats().stats())
                out.append(leaf(stats[1] / sum(stats) / len(model.trees) if sum(stats) else 0.0, bounds))
                continue
            split = node.split()
            f, t = split.featureIndex(), split.threshold()
            low, high = bounds.get(f, (-np.inf, np.inf))
            stack += [(node.leftChild(), bounds | {f: (low, min(high, t))}), (node.rightChild(), bounds | {f: (max(low, t), high)})]
    return out


def _patterns(leaves: list[Leaf], features: list[str]) -> Callable:
    """Weights of a task's rows by leaf and pattern."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[int, int], float] = {}
        for df in frames:
            x, w = df[features].to_numpy(float), df["_w"].to_numpy(float)
            for k, own in enumerate(leaves):
                pattern, at = np.unique(own.patterns(x), return_inverse=True)
                for p, n in zip(pattern.tolist(), np.bincount(at, w)):
                    sums[k, p] = sums.get((k, p), 0.0) + float(n)
        yield pd.DataFrame([(k, p, n) for (k, p), n in sums.items()], columns=["leaf", "pattern", "weight"])

    return run


def background_patterns(background: DataFrame, leaves: list[Leaf], features: list[str], weight: str | None = None) -> dict[int, list[tuple[int, float]]]:
    """For each leaf the patterns of the background's rows and their share of its weight.

    Only sums by leaf and pattern leave the tasks, whose number the forest bounds.
    """
    rows = background.select(*[c(f).cast("double").alias(f) for f in features], (c(weight).cast("double") if weight else F.lit(1.0)).alias("_w"))
    found = rows.mapInPandas(_patterns(leaves, features), "leaf int, pattern long, weight double").groupBy("leaf", "pattern").agg(F.sum("weight").alias("weight"))
    out: dict[int, list[tuple[int, float]]] = {}
    for r in found.collect():
        out.setdefault(r["leaf"], []).append((r["pattern"], r["weight"]))
    total = {k: sum(n for _, n in v) for k, v in out.items()}
    return {k: [(p, n / total[k]) for p, n in sorted(v)] for k, v in out.items()}


def _effects(own: Leaf, pattern: int, behind: list[tuple[int, float]]) -> np.ndarray:
    """What a leaf adds to its path's features for rows of a pattern."""
    k = len(own.features)
    out, full = np.zeros(k), (1 << k) - 1
    for other, share in behind:
        if pattern | other != full:
            continue  # some feature leaves the path either way
        mine, theirs = pattern & ~other, other & ~pattern
        a, b = mine.bit_count(), theirs.bit_count()
        for i in range(k):
            if mine >> i & 1:
                out[i] += share * own.value * factorial(a - 1) * factorial(b) / factorial(a + b)
            elif theirs >> i & 1:
                out[i] -= share * own.value * factorial(a) * factorial(b - 1) / factorial(a + b)
    return out


def tree_attributions(df: DataFrame, background: DataFrame, leaves: list[Leaf], features: list[str], key: str = "point_id", weight: str | None = None) -> DataFrame:
    """``(key, feature, attribution)`` for each row and feature; they add up to the row's score less the
    background's mean score.

    All rows of ``background`` count, by ``weight`` if one is named. A missing value goes to the right of
    every split. Without background rows nothing is attributed.
    """
    behind = background_patterns(background, leaves, features, weight)
    shared = df.sparkSession.sparkContext.broadcast((leaves, behind))  # bounded by the forest

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leaves, behind = shared.value
        known: dict[tuple[int, int], np.ndarray] = {}
        for rows in frames:
            x = rows[features].to_numpy(float)
            out = np.zeros((len(rows), len(features)))
            for k, own in enumerate(leaves):
                pattern, at = np.unique(own.patterns(x), return_inverse=True)
                for p in pattern.tolist():
                    if (k, p) not in known:
                        known[k, p] = _effects(own, p, behind.get(k, []))
                out[:, own.features] += np.stack([known[k, p] for p in pattern.tolist()])[at] if len(rows) else 0.0
            yield pd.DataFrame({key: rows[key], "_a": list(out)})

    kind = df.schema[key].dataType.simpleString()
    each = df.select(key, *[c(f).cast("double").alias(f) for f in features]).mapInPandas(run, f"{key} {kind}, _a array<double>")
    named = F.transform(F.arrays_zip(F.array(*map(F.lit, features)).alias("feature"), c("_a").alias("attribution")), lambda z: F.struct(z["feature"].alias("feature"), z["attribution"].alias("attribution")))
    return each.select(key, F.inline(named))


def attributions_cv(df: DataFrame, features: list[str], folds: int = 5, repeats: int = 2, trees: int = 50, depth: int = 8, key: str = "point_id", seed: int = 42) -> DataFrame:
    """``(key, repeat, fold, feature, attribution)``: each fold's rows by a forest fitted on the others,
    which are its background."""
    out = None
    for r in range(repeats):
        parts = materialise(stratified_folds(df, folds, 1, seed + r, key), "folds", ["fold"])
        for k in range(folds):
            train = parts.where(c("fold") != k)
            leaves = forest_leaves(fit_forest(train, features, trees, depth, seed + r))
            own = tree_attributions(parts.where(c("fold") == k), train, leaves, features, key)
            own = own.select(key, F.lit(r).alias("repeat"), F.lit(k).alias("fold"), "feature", "attribution")
            out = own if out is None else out.unionByName(own)
    return out
