"""Forests and boosted trees fitted on sums of rows of equal bins.

Trees see of an input only the bin it lies in, so rows that agree in all bins (a cell) differ for
them in their labels alone. One pass draws each row's place in the sample of every tree and adds up
draws and labels by cell; from then on a tree is fitted on the cells, with the draws as weights and
the mean of the drawn labels as label. For squared errors that is the tree which the rows give: the
spread of labels inside a cell adds the same to a node and to its children. There are never more
cells than rows, and at most as many as combinations of bins. Each cell gets its predictions, and
rows take those of their cell by a join.

Samples are drawn row by row, from the hash of the row's key: Poisson draws for a forest, one draw a
round for boosting. Boosting follows ``GBTRegressor``: the first tree counts in full, later ones fit
twice the residuals and count by the step size, and the first round that no longer helps the rows
marked ``is_validation`` ends it and is dropped.
"""

from __future__ import annotations

import math
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.session import cut_lineage, scratch

#: Quantiles that tell the values of an input with few of them; fits that run at a time.
MARKS, FITS = 1024, 4


def fits(estimator) -> bool:
    """Whether an estimator is one that can be fitted on cells: a node's least number of rows can't be told from them."""
    return isinstance(estimator, GBTRegressor | RandomForestRegressor) and estimator.getMinInstancesPerNode() == 1


def lower_bounds(data: DataFrame, inputs: list[str], bins: int) -> list[list[float]]:
    """Least values of all bins of each input but its first: one for each value if these are few, else quantiles."""
    marks = [i / MARKS for i in range(MARKS + 1)]
    found = data.agg(*[F.percentile_approx(c, marks, F.lit(10_000)).alias(c) for c in inputs]).first()
    out = []
    for c in inputs:
        values = np.array(found[c] or [0.0], np.float64)
        distinct = np.unique(values)
        if len(distinct) > bins:
            at = [math.ceil(i * MARKS / bins) for i in range(1, bins)]
            out.append(np.setdiff1d(values[at], distinct[:1]).tolist())
        else:
            out.append(distinct[1:].tolist())
    return out


def binned(data: DataFrame, inputs: list[str], bounds: list[list[float]]) -> DataFrame:
    """``data`` with the bin of each input in ``_bin0``, ``_bin1`` and so on."""
    # a bucket needs two bounds at least: an input of one value gets a bound that none reaches
    splits = [[-math.inf, *(b or [np.finfo(np.float64).max]), math.inf] for b in bounds]
    found = Bucketizer(splitsArray=splits, inputCols=inputs, outputCols=names(inputs)).transform(data)
    # buckets come marked as categories, which trees would part without regard to their order
    return found.select(*data.columns, *[F.col(c).alias(c, metadata={}) for c in names(inputs)])


def names(inputs: list[str]) -> list[str]:
    return [f"_bin{i}" for i in range(len(inputs))]


def drawn(estimator, key: Column, tree: int) -> Column:
    """How often a row is in the sample of a tree, from the hash of its key."""
    share, often = estimator.getSubsamplingRate(), isinstance(estimator, RandomForestRegressor) and estimator.getBootstrap()
    if share == 1.0 and not often:
        return F.lit(1)
    place = F.xxhash64(key, F.lit(estimator.getSeed()), F.lit(tree))
    below = lambda chance: place < F.lit(min(int(chance * 2**64) - 2**63, 2**63 - 1))
    if not often:
        return F.when(below(share), 1).otherwise(0)
    chance = upto = math.exp(-share)
    out = F.when(below(upto), 0)
    for k in range(1, 20):
        chance *= share / k
        if upto + chance <= upto:
            break
        upto += chance
        out = out.when(below(upto), k)
    return out.otherwise(k)


def _trees(estimator) -> int:
    return estimator.getMaxIter() if isinstance(estimator, GBTRegressor) else estimator.getNumTrees()


def cells_of(rows: DataFrame, inputs: list[str], label: str, key: list[str], estimators: dict[str, object]) -> DataFrame:
    """A row a cell: draws and drawn labels by tree of each estimator, count, mean and squared deviations of held-out labels."""
    y, hashed = F.col(label).cast("double"), F.col("_key")
    held = F.when(F.col("is_validation"), y)
    sums = [F.count(held).alias("_held"), F.coalesce(F.avg(held), F.lit(0.0)).alias("_mean"), F.coalesce(F.var_pop(held) * F.count(held), F.lit(0.0)).alias("_spread")]
    for name, estimator in estimators.items():
        for t in range(_trees(estimator)):
            w = F.when(F.col("is_validation") | y.isNull(), 0).otherwise(drawn(estimator, hashed, t))
            sums += [F.sum(w).alias(f"_n_{name}_{t}"), F.sum(w * y).alias(f"_s_{name}_{t}")]
    path = scratch(rows.sparkSession, "cells")
    keyed = rows.select(*names(inputs), label, "is_validation", F.xxhash64(*key).alias("_key"))
    keyed.groupBy(*names(inputs)).agg(*sums).write.parquet(path)
    return VectorAssembler(inputCols=names(inputs), outputCol="_bins").transform(rows.sparkSession.read.parquet(path))


def _sample(cells: DataFrame, name: str, tree: int, label: Column) -> DataFrame:
    """What a tree is fitted on; ``label`` is that of a cell, which its drawn labels' mean may be a part of."""
    n = F.col(f"_n_{name}_{tree}")
    return cells.where(n > 0).select("_bins", label.alias("_label"), n.cast("double").alias("_weight"))


def _drawn_mean(name: str, tree: int) -> Column:
    return F.col(f"_s_{name}_{tree}") / F.col(f"_n_{name}_{tree}")


def _settings(estimator) -> dict:
    return {
        "featuresCol": "_bins", "labelCol": "_label", "weightCol": "_weight", "maxDepth": estimator.getMaxDepth(), "maxBins": estimator.getMaxBins(),
        "minInfoGain": estimator.getMinInfoGain(), "minWeightFractionPerNode": estimator.getMinWeightFractionPerNode(),
    }


def forest_on(cells: DataFrame, name: str, estimator: RandomForestRegressor) -> DataFrame:
    """``cells`` with the mean prediction of the forest's trees as ``name``."""
    trees, inputs = estimator.getNumTrees(), estimator.getFeatureSubsetStrategy()
    if inputs == "auto":
        inputs = "all" if trees == 1 else "onethird"

    def fit(tree: int):
        one = RandomForestRegressor(numTrees=1, bootstrap=False, subsamplingRate=1.0, featureSubsetStrategy=inputs, seed=estimator.getSeed() + tree, **_settings(estimator))
        return one.setPredictionCol(f"_tree{tree}").fit(_sample(cells, name, tree, _drawn_mean(name, tree)))

    with ThreadPool(FITS) as pool:
        models = pool.map(inheritable_thread_target(cells.sparkSession)(fit), range(trees), 1)
    scored = reduce(lambda df, model: model.transform(df), models, cells)
    total = reduce(lambda a, b: a + b, [F.col(f"_tree{t}") for t in range(trees)])
    return scored.withColumn(name, total / trees).drop(*[f"_tree{t}" for t in range(trees)])


def boosted_on(cells: DataFrame, name: str, estimator: GBTRegressor) -> DataFrame:
    """``cells`` with the prediction of the boosted trees as ``name``."""
    watched = estimator.isDefined("validationIndicatorCol") and estimator.getOrDefault("validationIndicatorCol")
    sums = [c for t in range(_trees(estimator)) for c in (f"_n_{name}_{t}", f"_s_{name}_{t}")]
    now, best = cells.select(*[c for c in cells.columns if c.startswith("_bin")], "_held", "_mean", "_spread", *sums, F.lit(0.0).alias(name)), None
    for t in range(_trees(estimator)):
        weight, gap = (1.0, _drawn_mean(name, t)) if t == 0 else (estimator.getStepSize(), 2 * (_drawn_mean(name, t) - F.col(name)))
        one = DecisionTreeRegressor(seed=estimator.getSeed() + t, predictionCol="_tree", **_settings(estimator))
        model = one.fit(_sample(now, name, t, gap))
        after = cut_lineage(model.transform(now).withColumn(name, F.col(name) + weight * F.col("_tree")).drop("_tree"))
        if watched:
            squares = F.sum(F.col("_held") * F.pow(F.col(name) - F.col("_mean"), 2) + F.col("_spread"))
            error = after.agg(F.try_divide(squares, F.sum("_held"))).first()[0]
            if error is not None and best is not None and best - error < estimator.getValidationTol() * max(error, 0.01):
                break
            best = error
        now = after
    return now


def predicted(estimators: dict[str, object], data: DataFrame, inputs: list[str], label: str, key: list[str]) -> DataFrame:
    """``data`` with the prediction of each estimator, which are fitted on the rows that aren't ``is_validation``.

    ``key`` names the columns whose hash decides in which samples a row is; rows that share it are drawn alike.
    """
    spark = data.sparkSession
    known = data.where(F.col(label).isNotNull())
    bounds = lower_bounds(known.where("NOT is_validation"), inputs, min(e.getMaxBins() for e in estimators.values()))
    cells = cells_of(binned(data, inputs, bounds), inputs, label, key, estimators)
    on, scored = names(inputs), cells.select(*names(inputs))
    for name, estimator in estimators.items():
        fitted = (boosted_on if isinstance(estimator, GBTRegressor) else forest_on)(cells, name, estimator)
        scored = scored.join(fitted.select(*on, name), on)
    path = scratch(spark, "predictions")
    scored.write.parquet(path)
    return binned(data, inputs, bounds).join(spark.read.parquet(path), on).drop(*on)
