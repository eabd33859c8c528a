"""Exact Shapley values of fitted tree ensembles.

The value of a set of known inputs is the ensemble's mean over the training rows that
agree on these inputs, taken at each split from the shares of rows that went either way.
Under this game a leaf is a product: each input on its path either is known, and counts
1 or 0 as the row meets its conditions, or it isn't, and counts the share of rows that
do. So a leaf's Shapley values follow from the coefficients of one polynomial per path,
built up input by input; the number of subsets never enters.

All rows of an Arrow batch are taken at once: a leaf sees as many different rows as
there are patterns of met conditions, and the polynomial is worked out once a pattern.
The trees travel to the tasks as flat arrays; their size is that of the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.session import scratch

#: Paths with at most so many inputs keep a table of all patterns.
TABLED = 6


@dataclass(frozen=True)
class Leaf:
    """Inputs on a path with the interval (low, high] each is held to, the share of rows that meet it, and the leaf's value."""

    inputs: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: float


def saved_trees(model) -> tuple[dict[int, dict[int, tuple]], dict[int, float]]:
    """Nodes of each tree of a fitted model, and the trees' weights, from the files that the model saves.

    A node is (prediction, rows, left, right, input, threshold); left is negative in a leaf.
    """
    session, path = SparkSession.active(), scratch(SparkSession.active(), "model")
    model.save(path)
    rows = session.read.parquet(f"{path}/data")
    node = F.col("nodeData") if "nodeData" in rows.columns else F.struct("*")
    tree = F.col("treeID") if "treeID" in rows.columns else F.lit(0)
    held = rows.select(tree.cast("int").alias("tree"), node.alias("n")).select(
        "tree", "n.id", "n.prediction", F.get("n.impurityStats", F.lit(0)).alias("rows"), "n.leftChild", "n.rightChild",
        "n.split.featureIndex", F.get("n.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
    )
    trees: dict[int, dict[int, tuple]] = {}
    for r in held.collect():  # the model, which the driver holds already
        trees.setdefault(r.tree, {})[r.id] = (r.prediction, r.rows, r.leftChild, r.rightChild, r.featureIndex, r.threshold)
    weights = getattr(model, "treeWeights", None)
    if type(model).__name__.startswith("RandomForest"):
        weights = [1 / len(trees)] * len(trees)
    return trees, {t: (weights[t] if weights else 1.0) for t in trees}


def leaves(model) -> list[Leaf]:
    """All leaves of the model's trees, their values scaled by the tree's weight."""
    trees, weights = saved_trees(model)
    out: list[Leaf] = []

    def walk(nodes, at: int, held: dict[int, tuple[float, float, float]], weight: float) -> None:
        prediction, count, left, right, feature, threshold = nodes[at]
        if left < 0:
            keys = sorted(held)
            low, high, share = (np.array([held[k][i] for k in keys], np.float64) for i in range(3))
            out.append(Leaf(np.array(keys, np.int64), low, high, share, prediction * weight))
            return
        lo, hi, share = held.get(feature, (-np.inf, np.inf, 1.0))
        walk(nodes, left, held | {feature: (lo, min(hi, threshold), share * nodes[left][1] / count)}, weight)
        walk(nodes, right, held | {feature: (max(lo, threshold), hi, share * nodes[right][1] / count)}, weight)

    for t, nodes in sorted(trees.items()):
        walk(nodes, 0, {}, weights[t])
    return out


def path_weights(share: np.ndarray, met: np.ndarray) -> np.ndarray:
    """Shapley values of a leaf of value 1 for patterns (n, d) of met conditions."""
    n, d = met.shape
    weight = np.array([factorial(k) * factorial(d - k - 1) / factorial(d) for k in range(d)])
    out = np.empty((n, d))
    for i in range(d):
        poly = np.zeros((n, d))  # coefficient k: products over the others with k of them known
        poly[:, 0] = 1.0
        for j in range(d):
            if j != i:
                known = np.zeros((n, d))
                known[:, 1:] = poly[:, :-1] * met[:, j : j + 1]
                poly = poly * share[j] + known
        out[:, i] = (met[:, i] - share[i]) * (poly @ weight)
    return out


def contributions(found: list[Leaf], x: np.ndarray) -> np.ndarray:
    """Shapley values of all rows of ``x`` for all inputs."""
    columns = np.ascontiguousarray(x.T)
    out = np.zeros((x.shape[1], len(x)))
    for leaf in found:
        d = len(leaf.inputs)
        if not d:
            continue
        code = np.zeros(len(x), np.int64)
        for j, (f, lo, hi) in enumerate(zip(leaf.inputs, leaf.low, leaf.high)):
            code |= ((columns[f] > lo) & (columns[f] <= hi)).astype(np.int64) << j
        if d <= TABLED:
            kinds, which = np.arange(1 << d), code
        else:
            kinds, which = np.unique(code, return_inverse=True)
        table = path_weights(leaf.share, (kinds[:, None] >> np.arange(d) & 1).astype(np.float64)) * leaf.value
        for j, f in enumerate(leaf.inputs):
            out[f] += table[which, j]
    return out.T


def shapley_values(model, data: DataFrame, keys: list[str], inputs: list[str]) -> DataFrame:
    """keys, feature, contribution, base_value and prediction, a row for each input of each row.

    The base value is the ensemble's mean over its training rows; with the
    contributions of a row it adds up to the row's prediction.
    """
    spark = data.sparkSession
    found = leaves(model)
    base = float(sum(leaf.value * leaf.share.prod() for leaf in found))
    held = spark.sparkContext.broadcast([(leaf.inputs, leaf.low, leaf.high, leaf.share, leaf.value) for leaf in found])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = [Leaf(*parts) for parts in held.value]
        for batch in batches:
            parts = contributions(own, batch[inputs].to_numpy(dtype=float))
            out = batch[keys].loc[batch.index.repeat(len(inputs))].reset_index(drop=True)
            out["feature"] = np.tile(np.asarray(inputs, dtype=object), len(batch))
            out["contribution"] = parts.ravel()
            out["base_value"] = base
            out["prediction"] = np.repeat(base + parts.sum(axis=1), len(inputs))
            yield out

    types = dict(data.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", feature string, contribution double, base_value double, prediction double"
    return data.select(*keys, *inputs).mapInPandas(run, schema)
