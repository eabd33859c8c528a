"""Training sets, estimators, scoring, ensembles and attribution."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.functions import numeric
from seamline.operators import windows as win
from seamline.operators.aggregates import regression_quality
from seamline.plans import cell_trees
from seamline.session import scratch
from seamline.streaming.runner import options

MINIMUM_ROWS = 100
#: Bytes of a file that one task of a fit reads. Trees keep their rows in memory, at many times their size in a file.
FIT_SPLIT = {"spark.sql.files.maxPartitionBytes": str(16 << 20)}


# --- training data ---------------------------------------------------------------

def training_set(features: DataFrame, targets: DataFrame, keys: list[str], encode: list[str], required: list[str]) -> DataFrame:
    """Features joined with targets, categories encoded, incomplete rows dropped."""
    rows = features.join(targets, keys)
    for column in encode:
        rows = win.label_codes(rows, column, f"{column}_code")
    return rows.na.drop(subset=required)


def require_rows(df: DataFrame, minimum: int = MINIMUM_ROWS) -> DataFrame:
    """The frame itself, or an error when it is too small to train on."""
    if len(df.select(F.lit(1)).head(minimum)) < minimum:
        raise ValueError(f"fewer than {minimum} training rows")
    return df


def hold_out(df: DataFrame, key: list[str], share: float = 0.2, seed: int = 42, name: str = "is_validation") -> DataFrame:
    """Seeded split by key hash: the same row falls on the same side in every run."""
    draw = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(10_000)) / F.lit(10_000.0)
    return df.withColumn(name, draw < share)


def assembled(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="skip").transform(df)


# --- estimators --------------------------------------------------------------------

def boosted(label: str, rounds: int = 1000, depth: int = 6, step: float = 0.03, share: float = 0.8, seed: int = 42) -> GBTRegressor:
    """Boosting that stops early: once a round no longer helps the rows marked as validation."""
    return GBTRegressor(
        labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=step, subsamplingRate=share, seed=seed,
        validationIndicatorCol="is_validation", validationTol=0.01,
    )


def forest(label: str, trees: int = 100, depth: int = 10, seed: int = 42) -> RandomForestRegressor:
    """Bagged trees. Trees must end somewhere: nodes grow exponentially with ``depth``, at most 30."""
    return RandomForestRegressor(labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)


def linear(label: str) -> LinearRegression:
    return LinearRegression(labelCol=label, regParam=0.01)


def fit_on(estimator, data: DataFrame) -> Model:
    """Fit on what the estimator trains on, in tasks that hold a bounded part of a file."""
    train = data if isinstance(estimator, GBTRegressor) else data.where("NOT is_validation")
    with options(data.sparkSession, FIT_SPLIT):
        return estimator.fit(train)


def fitted_quality(estimator, data: DataFrame, label: str) -> tuple[Model, DataFrame]:
    """Fit and measure on both sides of the split."""
    model = fit_on(estimator, data)
    scored = model.transform(data).withColumn("part", F.when(F.col("is_validation"), "validation").otherwise("train"))
    return model, regression_quality(scored, label, "prediction", ["part"])


def cross_validated(estimator, data: DataFrame, label: str, folds: int = 5, seed: int = 42) -> tuple[float, float]:
    """Mean and deviation of the RMSE over random folds."""
    evaluator = RegressionEvaluator(labelCol=label, metricName="rmse")
    fitted = CrossValidator(
        estimator=estimator, estimatorParamMaps=[{}], evaluator=evaluator, numFolds=folds, seed=seed, parallelism=2
    ).fit(data)
    return fitted.avgMetrics[0], fitted.stdMetrics[0]


def time_ordered_search(make: Callable[..., object], grid: dict[str, list], data: DataFrame, order: list[str], label: str, splits: int = 3) -> list[dict]:
    """Mean RMSE of every parameter set over expanding time folds.

    Features and label are written once, in a folder for each block of time: a fit reads the
    blocks it trains on, and all models of a fold are measured in one pass over the block it tests.
    """
    spark, path = data.sparkSession, scratch(data.sparkSession, "blocks")
    win.time_blocks(data, order, splits).select("block", "features", label).write.partitionBy("block").parquet(path)
    blocks = spark.read.schema(data.select("features", label, F.lit(0).alias("block")).schema).parquet(path)
    builder = ParamGridBuilder()
    template = make()
    for name, values in grid.items():
        builder = builder.addGrid(template.getParam(name), values)
    sets, errors = builder.build(), []
    for fold in range(splits):
        train, scored = blocks.where(F.col("block") <= fold), blocks.where(F.col("block") == fold + 1)
        for i, params in enumerate(sets):
            scored = template.fit(train, params).setPredictionCol(f"_p{i}").transform(scored)
        rmse = [F.coalesce(F.sqrt(F.avg(F.pow(F.col(f"_p{i}") - F.col(label), 2))), F.lit(float("nan"))) for i in range(len(sets))]
        errors.append(scored.agg(*rmse).first())
    results = [{**{p.name: v for p, v in params.items()}, "rmse": sum(e[i] for e in errors) / splits} for i, params in enumerate(sets)]
    return sorted(results, key=lambda r: r["rmse"])


def tree_spread(model, data: DataFrame) -> DataFrame:
    """Forest prediction with the deviation of its trees, in one pass over the rows."""
    scored = data
    names = []
    for i, tree in enumerate(model.trees):
        names.append(f"_tree{i}")
        scored = tree.copy().setPredictionCol(names[-1]).transform(scored)
    values = F.array(*names)
    n = F.lit(float(len(names)))
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
    scored = scored.withColumn("prediction", mean)
    squares = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - F.col("prediction")) * (x - F.col("prediction")))
    return scored.withColumn("confidence", F.sqrt(squares / n)).drop(*names)


# --- scoring ------------------------------------------------------------------------

def linear_score(coefficients: dict[str, float], intercept: float = 0.0) -> Column:
    terms = [F.coalesce(F.col(c), F.lit(0.0)) * F.lit(w) for c, w in coefficients.items()]
    return reduce(lambda a, b: a + b, terms, F.lit(intercept))


def score_confidence(prediction: Column) -> Column:
    return numeric.clamp(1 - F.abs(prediction) / 2, 0.1, 1.0)


def batch_scores(df: DataFrame, key: str, coefficients: dict[str, float], intercept: float = 0.0) -> DataFrame:
    """Scores with confidence; rows without a key are set apart with an error."""
    prediction = F.when(F.col(key).isNotNull(), linear_score(coefficients, intercept))
    return df.withColumn("prediction", prediction).withColumns({
        "confidence": score_confidence(F.col("prediction")),
        "error": F.when(F.col(key).isNull(), "missing entity"),
    })


def ensemble(df: DataFrame, actual: str, predictions: list[str]) -> DataFrame:
    """Inverse-RMSE weights of the models and the ensemble's RMSE.

    Every error product is an aggregate of the same pass: the ensemble error is
    a quadratic form of the pairwise mean error products.
    """
    errors = {p: F.col(p) - F.col(actual) for p in predictions}
    pairs = [(a, b) for a in predictions for b in predictions]
    moments = df.agg(*[F.avg(errors[a] * errors[b]).alias(f"{a}__{b}") for a, b in pairs])
    inverse = {p: 1 / (F.sqrt(F.col(f"{p}__{p}")) + 1e-6) for p in predictions}
    total = reduce(lambda a, b: a + b, inverse.values())
    weight = {p: inverse[p] / total for p in predictions}
    squared = reduce(lambda a, b: a + b, [weight[a] * weight[b] * F.col(f"{a}__{b}") for a, b in pairs])
    rows = F.array(*[
        F.struct(F.lit(p).alias("model"), F.sqrt(F.col(f"{p}__{p}")).alias("rmse"), weight[p].alias("weight")) for p in predictions
    ])
    return moments.select(F.sqrt(squared).alias("ensemble_rmse"), F.inline(rows))


def fitted_ensemble(estimators: dict[str, object], data: DataFrame, label: str, inputs: list[str], key: list[str]) -> DataFrame:
    """Rows with the prediction of every fitted model and their weighted sum.

    Trees are fitted on sums of rows of equal bins (``cell_trees``), other models on the rows;
    ``inputs`` are the columns in ``features``, and ``key`` tells the rows apart. Weights are inverse
    validation errors, scaled to sum 1: a one-row subquery over the same scored rows.
    """
    trees = {name: e for name, e in estimators.items() if cell_trees.fits(e)}
    scored = cell_trees.predicted(trees, data, inputs, label, key) if trees else data
    for name, estimator in estimators.items():
        if name not in trees:
            scored = fit_on(estimator, data).setPredictionCol(name).transform(scored)
    held = ensemble(scored.where("is_validation"), label, list(estimators))
    weights = held.agg(F.map_from_entries(F.collect_list(F.struct("model", "weight")))).scalar()  # one per model
    terms = [F.col("_weights")[name] * F.col(name) for name in estimators]
    return scored.withColumn("_weights", weights).withColumn("prediction", reduce(lambda a, b: a + b, terms)).drop("_weights")


def linear_attribution(df: DataFrame, key: str, coefficients: dict[str, float], intercept: float) -> DataFrame:
    """Exact contributions coef · (x − mean) in long form, with base value and prediction."""
    means = df.agg(F.struct(*[F.avg(c).alias(c) for c in coefficients])).scalar()
    mean = {c: F.col("_means").getField(c) for c in coefficients}
    base = reduce(lambda a, b: a + b, [mean[c] * F.lit(w) for c, w in coefficients.items()], F.lit(intercept))
    contributions = F.array(*[
        F.struct(F.lit(c).alias("feature"), ((F.col(c) - mean[c]) * F.lit(w)).alias("contribution")) for c, w in coefficients.items()
    ])
    return df.withColumn("_means", means).select(
        key, base.alias("base_value"), linear_score(coefficients, intercept).alias("prediction"), F.inline(contributions)
    )


class _Tree:
    """One fitted tree as flat arrays, small enough to ship to every task."""

    def __init__(self, root):
        self.feature, self.threshold, self.left, self.right, self.value = [], [], [], [], []
        self._add(root)
        self.feature, self.left, self.right = (np.asarray(a, dtype=np.int64) for a in (self.feature, self.left, self.right))
        self.threshold, self.value = np.asarray(self.threshold), np.asarray(self.value)

    def _add(self, node) -> int:
        at = len(self.feature)
        inner = node.subtreeDepth() > 0
        self.feature.append(node.split().featureIndex() if inner else -1)
        self.threshold.append(node.split().threshold() if inner else 0.0)
        self.value.append(node.prediction())
        self.left.append(at)
        self.right.append(at)
        if inner:
            self.left[at] = self._add(node.leftChild())
            self.right[at] = self._add(node.rightChild())
        return at

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """Change of the node mean at each split on a row's path, by feature."""
        out = np.zeros(x.shape)
        at = np.zeros(len(x), dtype=np.int64)
        while (self.feature[at] >= 0).any():
            moving = np.flatnonzero(self.feature[at] >= 0)
            node = at[moving]
            feature = self.feature[node]
            child = np.where(x[moving, feature] <= self.threshold[node], self.left[node], self.right[node])
            out[moving, feature] += self.value[child] - self.value[node]
            at[moving] = child
        return out


def tree_attribution(model, data: DataFrame, keys: list[str], inputs: list[str]) -> DataFrame:
    """Path attribution of a forest: base value plus contributions is the prediction.

    The trees are read once on the driver; rows are walked in Arrow batches,
    all rows of a batch one level at a time.
    """
    trees = [_Tree(t._java_obj.rootNode()) for t in model.trees]
    base = float(np.mean([t.value[0] for t in trees]))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = np.mean([t.contributions(batch[inputs].to_numpy(dtype=float)) for t in trees], axis=0)
            out = batch[keys].loc[batch.index.repeat(len(inputs))].reset_index(drop=True)
            out["feature"] = np.tile(np.asarray(inputs, dtype=object), len(batch))
            out["contribution"] = parts.ravel()
            out["base_value"] = base
            out["prediction"] = np.repeat(base + parts.sum(axis=1), len(inputs))
            yield out

    types = dict(data.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", feature string, contribution double, base_value double, prediction double"
    return data.select(*keys, *inputs).mapInPandas(walk, schema)


def partial_pooling(df: DataFrame, group: str, value: str) -> DataFrame:
    """Group means shrunk towards the grand mean by method-of-moments variances.

    Only the per-group sufficient statistics are shuffled.
    """
    stats = df.groupBy(group).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("var")
    )
    total = F.sum("n")
    pooled = stats.agg(F.struct(
        (F.sum(F.col("n") * F.col("mean")) / total).alias("grand"),
        (F.sum((F.col("n") - 1) * F.col("var")) / F.greatest(total - F.count("*"), F.lit(1))).alias("within"),
        (F.var_samp("mean") - F.avg(1 / F.col("n")) * (F.sum((F.col("n") - 1) * F.col("var")) / F.greatest(total - F.count("*"), F.lit(1)))).alias("between"),
    )).scalar()
    p = F.col("_pooled")
    between = F.greatest(F.coalesce(p["between"], F.lit(0.0)), F.lit(0.0))
    shrink = F.coalesce(F.try_divide(between, between + p["within"] / F.col("n")), F.lit(0.0))
    return stats.withColumn("_pooled", pooled).select(
        group, "n", F.col("mean").alias("raw_mean"), shrink.alias("shrinkage"),
        (p["grand"] + shrink * (F.col("mean") - p["grand"])).alias("pooled_mean"),
        F.sqrt(p["within"] + shrink * p["within"] / F.col("n")).alias("predictive_std"),
    )


def promotable(rmse: Column, r2: Column) -> Column:
    return (rmse < 0.1) & (r2 > 0.7)

