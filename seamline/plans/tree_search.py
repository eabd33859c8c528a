"""Search over forest parameters on expanding time folds, all parameter sets in shared passes.

Inputs are cut into bins once. What a tree is grown from are counts and label sums of equal bins,
so rows come together first: one pass draws each row's place in every tree's sample and adds up
draws and labels by block of time and bins (a cell). All forests of all folds and leaf sizes then
grow together, one pass over the cells a level: a cell finds its node in every tree, each partition
adds up its sums by node, input and bin, and Spark sums these vectors by node. Where to split is
decided for each node by the task that holds its sums. A forest of fewer trees or levels is the
beginning of a larger one, so numbers of trees and depths cost no further passes: one last pass
scores the test cells of each fold for all, from their counts, means and squared deviations.

There are never more cells than rows, and at most as many as combinations of bins in a block.
What the driver holds is the splits: folds x leaf sizes x trees x nodes, set by the grid and
not by the rows; a task holds the sums of as many nodes. Rows with a null in the label or an
input are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.operators import windows as win
from seamline.session import cut_lineage

BINS = 32
#: Rows that a task brings together at once; cells for which a task is worth its sums, and its most.
CHUNK, LEAST_CELLS, MOST_CELLS, TASKS = 1 << 19, 1 << 13, 1 << 20, 32


def thresholds(data: DataFrame, inputs: list[str], bins: int = BINS) -> dict[str, np.ndarray]:
    """Bounds between bins: different quantiles of each input; at most ``bins`` - 1."""
    marks = [i / bins for i in range(1, bins)]
    found = data.agg(*[F.percentile_approx(c, marks, F.lit(10_000)).alias(c) for c in inputs]).first()
    return {c: np.unique(np.array(found[c] or [], np.float64)) for c in inputs}


def binned(data: DataFrame, inputs: list[str], bounds: dict[str, np.ndarray]) -> DataFrame:
    """``data`` with ``_bins``: bin b holds the values above bound b - 1 and up to bound b."""
    held = {c: b.tolist() for c, b in bounds.items()}
    above = lambda c: F.size(F.filter(F.lit(held[c]), lambda t: t < F.col(c))) if held[c] else F.lit(0)
    return data.withColumn("_bins", F.array(*[above(c) for c in inputs]))


def draws(keys: np.ndarray, tree: int) -> np.ndarray:
    """How often a row is in the sample of a tree: Poisson(1), from the hash of its key."""
    x = keys.astype(np.uint64) + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    u = (x >> np.uint64(11)).astype(np.float64) / (1 << 53)
    chance, upto, out = np.exp(-1.0), np.exp(-1.0), np.zeros(len(keys), np.int64)
    for k in range(1, 12):
        out += u >= upto
        chance /= k
        upto += chance
    return out


@dataclass
class Forests:
    """Splits and values of all trees; node k has the children 2k + 1 and 2k + 2."""

    folds: int
    leaf_sizes: list[int]
    trees: int
    depth: int
    bootstrap: bool
    feature: np.ndarray = field(init=False)
    cut: np.ndarray = field(init=False)
    value: np.ndarray = field(init=False)

    def __post_init__(self):
        shape = self.folds * len(self.leaf_sizes) * self.trees, (1 << (self.depth + 1)) - 1
        self.feature, self.cut, self.value = np.full(shape, -1, np.int8), np.zeros(shape, np.int16), np.full(shape, np.nan)

    def models(self, fold: int) -> range:
        size = len(self.leaf_sizes) * self.trees
        return range(fold * size, (fold + 1) * size)

    def step(self, model: int, node: np.ndarray, bins: np.ndarray) -> np.ndarray:
        """Child of each row's node; -1 below a leaf."""
        f = self.feature[model, node]
        right = bins[np.arange(len(node)), np.maximum(f, 0)] > self.cut[model, node]
        return np.where((node >= 0) & (f >= 0), 2 * node + 1 + right, -1)


def _chunks(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Arrow batches put together until they have ``size`` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= size:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if n:
        yield pd.concat(held, ignore_index=True)


def _drawn_sums(trees: int, bootstrap: bool):
    """Rows (block, _bins, sums): draws by tree, then drawn labels by tree, of the rows of a cell."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _chunks(batches, CHUNK):
            places = pd.DataFrame(np.stack(rows["_bins"].to_numpy())).assign(block=rows["block"])
            own = places.groupby(list(places.columns), sort=False).ngroup().to_numpy()
            first = np.unique(own, return_index=True)[1]
            y, keys, sums = rows["_y"].to_numpy(), rows["_key"].to_numpy(), np.zeros((len(first), 2 * trees))
            for t in range(trees):
                w = draws(keys, t) if bootstrap else np.ones(len(y), np.int64)
                sums[:, t], sums[:, trees + t] = np.bincount(own, w), np.bincount(own, w * y)
            yield pd.DataFrame({"block": rows["block"].to_numpy()[first], "_bins": rows["_bins"].to_numpy()[first], "sums": list(sums)})

    return run


def _level_sums(state: dict, level: int, width: int, inputs: int, last: bool):
    """Rows (model, node, sums) of a partition: counts, then label sums, by input and bin; only whole sums at the last level."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forests = Forests.__new__(Forests)
        forests.__dict__.update(state)
        added, slots = {}, 1 if last else inputs * width
        for cells in batches:
            for fold, part in cells.groupby("fold"):
                bins, drawn = np.stack(part["_bins"].to_numpy()).astype(np.int64), np.stack(part["sums"].to_numpy())
                place = np.zeros((len(bins), 1), np.int64) if last else bins + np.arange(inputs) * width
                for model in forests.models(fold):
                    w, s = drawn[:, model % forests.trees], drawn[:, forests.trees + model % forests.trees]
                    node = np.zeros(len(w), np.int64)
                    for _ in range(level):
                        node = forests.step(model, node, bins)
                    there = np.flatnonzero((node >= 0) & (w > 0))
                    if not len(there):
                        continue
                    at = ((node[there] - (1 << level) + 1)[:, None] * slots + place[there]).ravel()
                    sums = added.setdefault(model, np.zeros((2, (1 << level) * slots)))
                    for k, weights in enumerate((w, s)):
                        sums[k] += np.bincount(at, np.repeat(weights[there], place.shape[1]), sums.shape[1])
        for model, sums in added.items():
            by_node = sums.reshape(2, 1 << level, slots)
            nodes = np.flatnonzero(by_node[0].any(axis=1))
            yield pd.DataFrame({"model": model, "node": nodes + (1 << level) - 1, "sums": list(np.hstack([by_node[0][nodes], by_node[1][nodes]]))})

    return run


def _splits(leaf_sizes: list[int], trees: int, width: int, inputs: int, last: bool):
    """Best split of each node: the one with the largest sum of squared sums over counts, the first of equals."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums = np.stack(batch["sums"].to_numpy()).reshape(len(batch), 2, inputs, width)
            n, s = sums[:, 0].cumsum(axis=2), sums[:, 1].cumsum(axis=2)
            total, whole = n[:, 0, -1], s[:, 0, -1]
            least = np.array(leaf_sizes)[batch["model"].to_numpy() // trees % len(leaf_sizes)][:, None, None]
            right, rest = total[:, None, None] - n, whole[:, None, None] - s
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where((n >= least) & (right >= least), s**2 / n + rest**2 / right - (whole**2 / total)[:, None, None], -np.inf).reshape(len(batch), -1)
            best = gain.argmax(axis=1)
            split = (gain[np.arange(len(best)), best] > 1e-9 * (1 + whole**2 / total)) & (not last)
            yield pd.DataFrame({
                "model": batch["model"], "node": batch["node"], "value": whole / total,
                "feature": np.where(split, best // width, -1), "cut": np.where(split, best % width, 0),
            })

    return run


def grown(train: DataFrame, inputs: list[str], forests: Forests, width: int) -> Forests:
    """Grow all forests on cells (fold, _bins, sums), one pass a level."""
    for level in range(forests.depth + 1):
        held, last = dict(vars(forests)), level == forests.depth
        parts = train.mapInPandas(_level_sums(held, level, width, len(inputs), last), "model int, node int, sums array<double>")
        summed = parts.groupBy("model", "node").agg(_added("sums"))
        shape = (1, 1) if last else (width, len(inputs))
        decided = summed.mapInPandas(_splits(forests.leaf_sizes, forests.trees, *shape, last), "model int, node int, value double, feature int, cut int")
        found = decided.toPandas()
        model, node = found["model"].to_numpy(), found["node"].to_numpy()
        forests.value[model, node], forests.feature[model, node], forests.cut[model, node] = found["value"], found["feature"], found["cut"]
        if not (found["feature"] >= 0).any():
            break
    return forests


def _added(sums: str) -> Column:
    return vector_to_array(Summarizer.sum(array_to_vector(sums))).alias(sums)


def training_cells(rows: DataFrame, forests: Forests) -> DataFrame:
    """(fold, _bins, sums) from rows (block, _key, _bins, _y): what each fold trains on."""
    drawn = rows.where(F.col("block") < forests.folds).mapInPandas(_drawn_sums(forests.trees, forests.bootstrap), "block int, _bins array<int>, sums array<double>")
    by_block = drawn.groupBy("block", "_bins").agg(_added("sums"))
    folds = by_block.withColumn("fold", F.explode(F.sequence(F.col("block"), F.lit(forests.folds - 1))))
    cells = cut_lineage(folds.groupBy("fold", "_bins").agg(_added("sums")))
    n = cells.count()
    tasks = max(-(-n // MOST_CELLS), min(-(-n // LEAST_CELLS), TASKS), 1)
    return cut_lineage(cells.repartition(tasks, "fold", "_bins"))


def _errors(state: dict, trees: list[int], depths: list[int]):
    """Squared errors of each fold, leaf size, number of trees and depth over the cells (fold, _bins, n, mean, spread) of a partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forests = Forests.__new__(Forests)
        forests.__dict__.update(state)
        for batch in batches:
            for fold, part in batch.groupby("fold"):
                bins, mean = np.stack(part["_bins"].to_numpy()).astype(np.int64), part["mean"].to_numpy()
                n, spread = part["n"].to_numpy(), part["spread"].sum()
                for k, leaf in enumerate(forests.leaf_sizes):
                    total = np.zeros((forests.depth + 1, len(n)))
                    for t in range(forests.trees):
                        model = (fold * len(forests.leaf_sizes) + k) * forests.trees + t
                        node, value = np.zeros(len(n), np.int64), forests.value[model, 0] * np.ones(len(n))
                        for level in range(forests.depth + 1):
                            value = np.where(node >= 0, forests.value[model, np.maximum(node, 0)], value)
                            total[level] += value
                            node = forests.step(model, node, bins)
                        if t + 1 in trees:
                            yield pd.DataFrame({
                                "fold": fold, "leaf_size": leaf, "trees": t + 1, "depth": depths, "n": n.sum(),
                                "squares": [(n * (total[d] / (t + 1) - mean) ** 2).sum() + spread for d in depths],
                            })

    return run


def forest_search(
    data: DataFrame, inputs: list[str], label: str, order: list[str], trees: list[int], depths: list[int], leaf_sizes: list[int],
    splits: int = 3, bins: int = BINS, bootstrap: bool = True,
) -> DataFrame:
    """(trees, depth, leaf_size, rmse): mean error over expanding time folds of each parameter set, best first."""
    rows = data.dropna(subset=[label, *inputs]).select(*dict.fromkeys([*order, label, *inputs]))
    bounds = thresholds(rows, inputs, bins)
    width = max(len(b) for b in bounds.values()) + 1
    places = binned(rows, inputs, bounds).select(*order, "_bins", F.col(label).cast("double").alias("_y"))
    blocks = win.time_blocks(places, order, splits).select("block", F.xxhash64(*order).alias("_key"), "_bins", "_y")
    forests = Forests(splits, list(leaf_sizes), max(trees), max(depths), bootstrap)
    forests = grown(training_cells(blocks, forests), inputs, forests, width)
    tested = blocks.where("block > 0").groupBy((F.col("block") - 1).alias("fold"), "_bins").agg(
        F.count("*").alias("n"), F.avg("_y").alias("mean"), (F.var_pop("_y") * F.count("*")).alias("spread")
    )
    errors = tested.mapInPandas(
        _errors(dict(vars(forests)), list(trees), list(depths)), "fold int, leaf_size int, trees int, depth int, n long, squares double"
    )
    each = errors.groupBy("fold", "trees", "depth", "leaf_size").agg(F.sqrt(F.sum("squares") / F.sum("n")).alias("rmse"))
    return each.groupBy("trees", "depth", "leaf_size").agg(F.avg("rmse").alias("rmse")).orderBy("rmse", "trees", "depth", "leaf_size")
