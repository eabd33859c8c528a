"""Trees fitted on sums of rows of equal bins are those that the rows give."""

import pytest
from pyspark.ml import Estimator
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from seamline.plans import cell_trees, models


@pytest.fixture(scope="module")
def rows(spark):
    noise = F.pmod(F.xxhash64("id"), F.lit(1000)) / 250
    df = spark.range(3000).select("id", (F.col("id") % 10).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"), noise.alias("noise"))
    df = df.withColumn("y", F.col("a") * F.col("b") / 5 + F.when(F.col("a") > 6, 3.0).otherwise(0.0) + F.col("noise"))
    return models.assembled(models.hold_out(df, ["id"]), ["a", "b"]).cache()


@pytest.mark.parametrize("watched", [True, False])
def test_trees_on_cells_are_those_on_rows(spark, rows, watched):
    marked = {"validationIndicatorCol": "is_validation", "validationTol": 0.05} if watched else {}
    kinds = {
        "forest": RandomForestRegressor(labelCol="y", numTrees=1, maxDepth=4, bootstrap=False, seed=1),
        "boosted": GBTRegressor(labelCol="y", maxIter=8, maxDepth=3, stepSize=0.3, seed=1, **marked),
        "linear": models.linear("y"),
    }
    got = {r.id: r for r in models.fitted_ensemble(kinds, rows, "y", ["a", "b"], ["id"]).collect()}
    assert len(got) == 3000
    for name, estimator in kinds.items():
        train = rows if name == "boosted" and watched else rows.where("NOT is_validation")
        for r in estimator.fit(train).transform(rows).collect():
            assert got[r.id][name] == pytest.approx(r.prediction, abs=1e-9), name


def test_tree_fits_read_cells(spark, rows, monkeypatch):
    """What a tree is fitted on grows with the combinations of bins, not with the rows."""
    seen, fit = [], Estimator.fit
    monkeypatch.setattr(Estimator, "fit", lambda self, data, params=None: (seen.append((type(self).__name__, data.count())), fit(self, data, params))[1])
    kinds = {"forest": models.forest("y", trees=3, depth=3), "boosted": models.boosted("y", rounds=2, depth=2), "linear": models.linear("y")}
    models.fitted_ensemble(kinds, rows, "y", ["a", "b"], ["id"]).collect()
    trees = [n for kind, n in seen if kind != "LinearRegression"]
    assert len(trees) == 5 and max(trees) <= 70


def test_draws_are_those_of_each_row(spark, rows):
    forest, boosted = models.forest("y", trees=2, depth=2), models.boosted("y", rounds=2, depth=2)
    keyed = rows.withColumn("_key", F.xxhash64("id"))
    held = keyed.select(*[cell_trees.drawn(e, F.col("_key"), t).alias(f"{n}{t}") for n, e in (("f", forest), ("b", boosted)) for t in (0, 1)], "is_validation", "y", "a", "b")
    seen = held.toPandas()
    for t in (0, 1):
        assert abs(seen[f"f{t}"].mean() - 1) < 0.06 and abs(seen[f"f{t}"].var() - 1) < 0.12 and abs((seen[f"f{t}"] == 0).mean() - 0.368) < 0.03
        assert set(seen[f"b{t}"]) == {0, 1} and abs(seen[f"b{t}"].mean() - 0.8) < 0.03
    assert (seen["f0"] != seen["f1"]).any() and (seen["b0"] != seen["b1"]).any()
    bounds = cell_trees.lower_bounds(rows, ["a", "b"], 32)
    assert bounds == [[float(x) for x in range(1, 10)], [float(x) for x in range(1, 7)]]
    cells = cell_trees.cells_of(cell_trees.binned(rows.repartition(5), ["a", "b"], bounds), ["a", "b"], "y", ["id"], {"f": forest, "b": boosted}).toPandas()
    train = seen[~seen["is_validation"]]
    for name in ("f0", "f1", "b0", "b1"):
        own = train.assign(n=train[name], s=train[name] * train["y"]).groupby(["a", "b"])[["n", "s"]].sum()
        for r in cells.to_dict("records"):
            n, s = own.loc[(r["_bin0"], r["_bin1"])]
            assert r[f"_n_{name[0]}_{name[1]}"] == n and r[f"_s_{name[0]}_{name[1]}"] == pytest.approx(s)


def test_many_values_come_to_bins_of_like_size(spark):
    df = spark.range(10_000).select((F.col("id") * 1.5).alias("x"), F.lit(3.0).alias("same"))
    bounds = cell_trees.lower_bounds(df, ["x", "same"], 32)
    assert len(bounds[0]) == 31 and bounds[1] == []
    sizes = {r[0]: r[1] for r in cell_trees.binned(df, ["x", "same"], bounds).groupBy("_bin0").count().collect()}
    assert len(sizes) == 32 and min(sizes.values()) > 250 and max(sizes.values()) < 380
