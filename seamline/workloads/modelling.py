"""Models, ensembles, attribution and scenarios."""

from __future__ import annotations

import math

from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from seamline import fixed
from seamline.functions import numeric
from seamline.operators import aggregates as agg
from seamline.operators import relational as rel
from seamline.operators import windows as win
from seamline.plans import attribution, features, models, scenarios, tree_search
from seamline.workloads import standins as st
from seamline.workloads.aggregations import WEIGHTED_SQL
from seamline.workloads.registry import query

INPUTS = ["l_quantity", "l_discount", "l_tax", "line"]
#: Size of the models that queries fit; the estimators' own defaults are larger.
TREES, DEPTH = 20, 5
BOOSTED = {"rounds": 10, "depth": 4, "step": 0.1}


def _targets(spark, sf):
    gold = st.gold_features(spark, sf)
    deltas = win.deltas(gold, "mine_id", "feature_date", "feature_freshness_score")
    return gold, deltas.select("mine_id", "feature_date", F.col("delta").alias("target"))


@query("m01_training_set", """
WITH t AS (SELECT mine_id, feature_date, round(feature_freshness_score - lag(feature_freshness_score) OVER (PARTITION BY mine_id ORDER BY feature_date), 9) AS target FROM gold_features),
j AS (SELECT g.mine_id, g.feature_date, e.country_code, g.production_mt, g.esg_score, t.target FROM gold_features g JOIN entity_country e ON g.mine_id = e.mine_id
  JOIN t ON g.mine_id = t.mine_id AND g.feature_date = t.feature_date WHERE t.target IS NOT NULL)
SELECT mine_id, feature_date, dense_rank() OVER (ORDER BY country_code) - 1 AS country_code_code, production_mt, esg_score, round(target, 6) AS target
FROM j QUALIFY esg_score IS NOT NULL
""")
def training_set(spark, sf):
    gold, targets = _targets(spark, sf)
    frame = gold.join(st.entity_country(spark, sf), "mine_id").select("mine_id", "feature_date", "country_code", "production_mt", "esg_score")
    rows = models.training_set(frame, targets, ["mine_id", "feature_date"], ["country_code"], ["production_mt", "esg_score", "target"])
    return rows.drop("country_code")


def _learning(spark, sf):
    frame = st.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_discount", "l_tax",
        F.col("l_linenumber").cast("double").alias("line"), (F.col("l_extendedprice") / 1000).alias("label"),
    )
    return models.assembled(models.hold_out(frame, ["l_orderkey", "l_linenumber", "l_quantity"]), INPUTS)


@query("m02_boosted_regression")
def boosted_regression(spark, sf):
    data = models.require_rows(_learning(spark, sf))
    return models.fitted_quality(models.boosted("label", **BOOSTED), data, "label")[1]


@query("m03_forest_and_linear")
def forest_and_linear(spark, sf):
    data = _learning(spark, sf)
    forest = models.fitted_quality(models.forest("label", trees=TREES, depth=DEPTH), data, "label")[1]
    linear = models.fitted_quality(models.linear("label"), data, "label")[1]
    return forest.withColumn("model", F.lit("forest")).unionByName(linear.withColumn("model", F.lit("linear")))


@query("m04_hold_out_and_folds")
def hold_out_and_folds(spark, sf):
    data = _learning(spark, sf)
    mean, std = models.cross_validated(models.linear("label"), data.where("NOT is_validation"), "label")
    return data.groupBy("is_validation").agg(F.count("*").alias("n")).withColumns({"cv_rmse": F.lit(mean), "cv_std": F.lit(std)})


@query("m05_parameter_search")
def parameter_search(spark, sf):
    """Forests of each number of trees, depth and leaf size, in expanding folds of the ship dates."""
    data = _learning(spark, sf)
    return tree_search.forest_search(
        data, INPUTS, "label", ["l_shipdate", "l_orderkey", "l_linenumber", "l_quantity"], trees=[5, 10, 20], depths=[4, 6, 8], leaf_sizes=[1, 4, 16], splits=3
    )


@query("m05_linear_search")
def linear_search(spark, sf):
    data = _learning(spark, sf).select("l_shipdate", "l_orderkey", "l_linenumber", "features", "label")
    found = models.time_ordered_search(
        lambda: models.linear("label"), {"regParam": [0.0, 0.1], "elasticNetParam": [0.0, 1.0]}, data,
        ["l_shipdate", "l_orderkey", "l_linenumber"], "label", splits=3,
    )
    return spark.createDataFrame(found, "regParam double, elasticNetParam double, rmse double")


@query("m06_ensemble", """
WITH p AS (SELECT l_extendedprice / 1000 AS y, l_quantity * 1.5 AS a, l_quantity * 1.2 + 6 AS b, 38.0 + 0 * l_quantity AS c FROM lineitem),
r AS (SELECT sqrt(avg((a - y) ** 2)) AS ra, sqrt(avg((b - y) ** 2)) AS rb, sqrt(avg((c - y) ** 2)) AS rc FROM p),
w AS (SELECT *, 1 / (ra + 1e-6) AS ia, 1 / (rb + 1e-6) AS ib, 1 / (rc + 1e-6) AS ic FROM r),
e AS (SELECT sqrt(avg(((a * ia + b * ib + c * ic) / (ia + ib + ic) - y) ** 2)) AS ensemble_rmse FROM p, w)
SELECT 'a' AS model, round(ra, 6) AS rmse, round(ia / (ia + ib + ic), 6) AS weight, round(ensemble_rmse, 6) AS ensemble_rmse FROM w, e
UNION ALL SELECT 'b', round(rb, 6), round(ib / (ia + ib + ic), 6), round(ensemble_rmse, 6) FROM w, e
UNION ALL SELECT 'c', round(rc, 6), round(ic / (ia + ib + ic), 6), round(ensemble_rmse, 6) FROM w, e
""")
def ensemble(spark, sf):
    q = F.col("l_quantity")
    predicted = st.table(spark, sf, "lineitem").select(
        (F.col("l_extendedprice") / 1000).alias("y"), (q * 1.5).alias("a"), (q * 1.2 + 6).alias("b"), (38.0 + q * 0).alias("c")
    )
    return models.ensemble(predicted, "y", ["a", "b", "c"])


@query("m06_fitted_ensemble")
def fitted_ensemble(spark, sf):
    kinds = {"forest": models.forest("label", trees=TREES, depth=DEPTH), "boosted": models.boosted("label", **BOOSTED), "linear": models.linear("label")}
    rows = models.fitted_ensemble(kinds, _learning(spark, sf), "label", INPUTS, ["l_orderkey", "l_linenumber", "l_quantity"])
    return rows.select("l_orderkey", "l_linenumber", "label", *kinds, "prediction")


COEFFICIENTS = {"production_mt": 0.002, "esg_score": -0.01, "revenue": 0.001}


@query("m07_batch_scoring", """
WITH e AS (SELECT CASE WHEN incidents > 3 THEN NULL ELSE mine_id END AS entity, feature_date, production_mt, esg_score, revenue FROM gold_features),
p AS (SELECT *, CASE WHEN entity IS NOT NULL THEN 0.1 + production_mt * 0.002 + coalesce(esg_score, 0) * -0.01 + revenue * 0.001 END AS prediction FROM e)
SELECT entity, feature_date, round(prediction, 6) AS prediction, round(greatest(0.1, least(1.0, 1 - abs(prediction) / 2)) * (prediction / prediction), 6) AS confidence,
  CASE WHEN entity IS NULL THEN 'missing entity' END AS error FROM p
""")
def batch_scoring(spark, sf):
    rows = st.gold_features(spark, sf).withColumn("entity", F.when(F.col("incidents") <= 3, F.col("mine_id")))
    return models.batch_scores(rows, "entity", COEFFICIENTS, 0.1).select("entity", "feature_date", "prediction", "confidence", "error")


@query("m08_tree_spread")
def tree_spread(spark, sf):
    data = _learning(spark, sf)
    model = models.forest("label", trees=TREES, depth=DEPTH).fit(data.where("NOT is_validation"))
    return models.tree_spread(model, data.where("is_validation")).select("l_orderkey", "l_linenumber", "prediction", "confidence")


ATTRIBUTION_SQL = """WITH m AS (SELECT avg(production_mt) AS a, avg(capacity_mt) AS b, avg(revenue) AS c FROM gold_features),
base AS (SELECT concat(mine_id, '@', strftime(feature_date, '%Y-%m-%d')) AS sample_id, 5 + production_mt * 0.2 + capacity_mt * -0.01 + revenue * 0.3 AS prediction,
  5 + a * 0.2 + b * -0.01 + c * 0.3 AS base_value, (production_mt - a) * 0.2 AS ca, (capacity_mt - b) * -0.01 AS cb, (revenue - c) * 0.3 AS cc FROM gold_features, m)"""
ATTRIBUTION = {"production_mt": 0.2, "capacity_mt": -0.01, "revenue": 0.3}


def _attributed(spark, sf):
    sample = F.concat_ws("@", F.col("mine_id").cast("string"), F.date_format("feature_date", "yyyy-MM-dd"))
    return models.linear_attribution(st.gold_features(spark, sf).withColumn("sample_id", sample), "sample_id", ATTRIBUTION, 5.0)


@query("m09_feature_attribution", ATTRIBUTION_SQL + """
SELECT sample_id, 'production_mt' AS feature, round(ca, 6) AS contribution, round(base_value, 6) AS base_value, round(prediction, 6) AS prediction FROM base
UNION ALL SELECT sample_id, 'capacity_mt', round(cb, 6), round(base_value, 6), round(prediction, 6) FROM base
UNION ALL SELECT sample_id, 'revenue', round(cc, 6), round(base_value, 6), round(prediction, 6) FROM base""")
def feature_attribution(spark, sf):
    return _attributed(spark, sf)


@query("m09_tree_attribution")
def tree_attribution(spark, sf):
    data = _learning(spark, sf)
    model = models.forest("label", trees=TREES, depth=DEPTH).fit(data.where("NOT is_validation"))
    return attribution.shapley_values(model, data.where("is_validation"), ["l_orderkey", "l_linenumber"], INPUTS)


@query("m09_shapley_additivity", """
SELECT l_orderkey, l_linenumber, 4::BIGINT AS features, 0.0::DOUBLE AS gap FROM lineitem WHERE l_orderkey % 5 = 0
GROUP BY l_orderkey, l_linenumber, l_quantity, l_discount, l_tax
""", digits=9)
def shapley_additivity(spark, sf):
    """Base value and contributions of each row, against what the model itself predicts."""
    data = _learning(spark, sf)
    model = models.forest("label", trees=TREES, depth=DEPTH).fit(data.where("l_orderkey % 5 <> 0"))
    rows = data.where("l_orderkey % 5 = 0").withColumn("row", F.xxhash64(*INPUTS)).dropDuplicates(["l_orderkey", "l_linenumber", "row"])
    keys = ["l_orderkey", "l_linenumber", "row"]
    added = attribution.shapley_values(model, rows, keys, INPUTS).groupBy(*keys).agg(
        F.count("*").alias("features"), (F.sum("contribution") + F.first("base_value")).alias("total")
    )
    gap = F.abs(F.col("total") - F.col("prediction"))
    return added.join(model.transform(rows).select(*keys, "prediction"), keys).select("l_orderkey", "l_linenumber", "features", gap.alias("gap"))


@query("m09_stump_attribution", """
WITH d AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 1000 AS label, CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END AS large FROM lineitem),
m AS (SELECT large, avg(label) AS mean FROM d GROUP BY large), b AS (SELECT avg(label) AS base FROM d)
SELECT l_orderkey, l_linenumber, 'large' AS feature, round(mean - base, 6) AS contribution, round(base, 6) AS base_value, round(mean, 6) AS prediction FROM d JOIN m USING (large), b
""")
def stump_attribution(spark, sf):
    """One split on a flag: its contribution is the group's mean less the overall mean."""
    flagged = st.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 1000).alias("label"), (F.col("l_quantity") > 25).cast("double").alias("large")
    )
    data = models.assembled(flagged, ["large"])
    model = DecisionTreeRegressor(labelCol="label", maxDepth=1, seed=1).fit(data)
    return attribution.shapley_values(model, data, ["l_orderkey", "l_linenumber"], ["large"])


@query("m10_partial_pooling", """
WITH s AS (SELECT concat(sub_industry, '/', coalesce(country, '-')) AS grp, count(score) AS n, avg(score) AS mean, coalesce(var_samp(score), 0) AS var FROM composite_scores GROUP BY 1),
p AS (SELECT sum(n * mean) / sum(n) AS grand, sum((n - 1) * var) / greatest(sum(n) - count(*), 1) AS within, var_samp(mean) AS vm, avg(1.0 / n) AS inv FROM s),
b AS (SELECT *, greatest(vm - inv * within, 0) AS between_var FROM p),
k AS (SELECT s.*, b.*, between_var / nullif(between_var + within / n, 0) AS shrink FROM s, b)
SELECT grp, n, round(mean, 6) AS raw_mean, round(coalesce(shrink, 0), 6) AS shrinkage, round(grand + coalesce(shrink, 0) * (mean - grand), 6) AS pooled_mean,
  round(sqrt(within + coalesce(shrink, 0) * within / n), 6) AS predictive_std FROM k
""")
def partial_pooling(spark, sf):
    group = F.concat_ws("/", "sub_industry", F.coalesce("country", F.lit("-")))
    return models.partial_pooling(st.composite_scores(spark, sf).withColumn("grp", group), "grp", "score")


CHANGES = {"emissions_score": -15.0, "economic_score": 20.0, "ecological_score": 5.0}
SHIFT_SQL = "sh AS (SELECT *, CASE metric " + " ".join(
    f"WHEN '{m}' THEN greatest(0, least(100, value + {c}))" for m, c in CHANGES.items()
) + " ELSE value END AS scenario_value FROM component_long)"
LONG_WEIGHT_SQL = "CASE metric " + " ".join(f"WHEN '{m}' THEN {w}::DOUBLE" for m, w in fixed.COMPONENT_WEIGHTS.items()) + " END"


@query("m11_scenario_shift", f"""WITH {SHIFT_SQL} SELECT entity_id, round(sum(scenario_value * {LONG_WEIGHT_SQL}), 9) AS score FROM sh GROUP BY entity_id""", digits=9)
def scenario_shift(spark, sf):
    return st.entity_components(spark, sf).select("entity_id", scenarios.scenario_score(CHANGES).alias("score"))


@query("m12_scenario_comparison", f"""WITH {SHIFT_SQL},
s AS (SELECT entity_id, sum(value * {LONG_WEIGHT_SQL}) AS baseline, sum(scenario_value * {LONG_WEIGHT_SQL}) AS scenario,
  {', '.join(f"max(CASE WHEN metric = '{m}' THEN scenario_value - value END) AS impact_{m}" for m in CHANGES)} FROM sh GROUP BY entity_id),
c AS (SELECT *, scenario - baseline AS change, coalesce((scenario - baseline) / nullif(baseline, 0) * 100, 0) AS percent FROM s)
SELECT entity_id, round(baseline, 9) AS baseline, round(scenario, 9) AS scenario, round(change, 9) AS change, round(percent, 6) AS percent,
  {', '.join(f'round(impact_{m}, 6) AS impact_{m}' for m in CHANGES)},
  CASE WHEN abs(percent) > 5 THEN 'significant' WHEN abs(percent) > 2 THEN 'moderate' ELSE 'minor' END AS magnitude, change > 0 AS rises FROM c
""", digits={"baseline": 9, "scenario": 9, "change": 9})
def scenario_comparison(spark, sf):
    compared = scenarios.comparison(st.entity_components(spark, sf), CHANGES)
    return compared.select(
        "entity_id", "baseline", "scenario", "change", "percent", *[f"impact_{m}" for m in CHANGES],
        F.regexp_extract("explanation", "results in a ([a-z]+)", 1).alias("magnitude"), F.col("explanation").contains("increase").alias("rises"),
    )


DRAWS = 1000
SHIFTS = {"emissions_score": ("normal", 2.0, 6.0), "economic_score": ("uniform", -10.0, 10.0), "ecological_score": ("fixed", 3.0, 0.0)}


def _u(metric, tag=None):
    tail = f", '|', '{tag}'" if tag else ""
    return f"(CAST(concat('0x', md5(concat(draw, '|', '{metric}'{tail}))[1:8]) AS BIGINT) / 4294967296.0)"


NORMAL_SQL = f"(sqrt(-2 * ln(1 - {_u('emissions_score', 'a')})) * cos({2 * math.pi!r} * {_u('emissions_score', 'b')}))"
MC_VALUE = {
    "emissions_score": f"greatest(0, least(100, emissions_score + 2 + 6 * {NORMAL_SQL}))",
    "economic_score": f"greatest(0, least(100, economic_score - 10 + 20 * {_u('economic_score')}))",
    "ecological_score": "greatest(0, least(100, ecological_score + 3))",
}
MC_SCORE = " + ".join(f"{MC_VALUE.get(m, m)} * {w}" for m, w in fixed.COMPONENT_WEIGHTS.items())


@query("m13_monte_carlo", f"""
WITH d AS (SELECT *, unnest(range(1, {DRAWS + 1})) AS draw FROM entity_components), s AS (SELECT entity_id, {MC_SCORE} AS score FROM d)
SELECT entity_id, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, round(quantile_cont(score, 0.05), 6) AS p05,
  round(quantile_cont(score, 0.25), 6) AS p25, round(quantile_cont(score, 0.75), 6) AS p75, round(quantile_cont(score, 0.95), 6) AS p95 FROM s GROUP BY 1
""")
def monte_carlo(spark, sf):
    return scenarios.monte_carlo(st.entity_components(spark, sf), ["entity_id"], SHIFTS, DRAWS)


@query("m14_difference_interval", """
WITH s AS (SELECT sub_industry, avg(score) FILTER (horizon = 5) AS a, stddev_samp(score) FILTER (horizon = 5) AS sa,
  avg(score) FILTER (horizon = 20) AS b, stddev_samp(score) FILTER (horizon = 20) AS sb FROM composite_scores GROUP BY 1)
SELECT sub_industry, round(b - a, 6) AS difference, round(b - a - 1.959963984540054 * sqrt(sa * sa + sb * sb), 6) AS lower,
  round(b - a + 1.959963984540054 * sqrt(sa * sa + sb * sb), 6) AS upper FROM s
""")
def difference_interval(spark, sf):
    at = lambda h: F.when(F.col("horizon") == h, F.col("score"))
    s = st.composite_scores(spark, sf).groupBy("sub_industry").agg(
        F.avg(at(5)).alias("a"), F.stddev_samp(at(5)).alias("sa"), F.avg(at(20)).alias("b"), F.stddev_samp(at(20)).alias("sb"))
    interval = scenarios.difference_interval(F.col("a"), F.col("sa"), F.col("b"), F.col("sb"), 0.95)
    return s.select("sub_industry", (F.col("b") - F.col("a")).alias("difference"), interval.alias("i")).select(
        "sub_industry", "difference", "i.lower", "i.upper")


RUNS_SQL = "runs AS (SELECT sub_industry AS model_type, score_id AS model_version, score / 500 AS rmse, 1 - score / 200 AS r2, created_at, horizon <> 20 AS is_active FROM composite_scores)"


def _runs(spark, sf):
    s = F.col("score")
    return st.composite_scores(spark, sf).select(
        F.col("sub_industry").alias("model_type"), F.col("score_id").alias("model_version"), (s / 500).alias("rmse"),
        (1 - s / 200).alias("r2"), "created_at", (F.col("horizon") != 20).alias("is_active"),
    )


@query("m15_model_registry", f"""WITH {RUNS_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY model_type ORDER BY created_at DESC, model_version DESC) AS rn FROM runs WHERE is_active)
SELECT model_type, model_version, round(rmse, 6) AS rmse, round(r2, 6) AS r2, rmse < 0.1 AND r2 > 0.7 AS promote FROM a WHERE rn = 1
""")
def model_registry(spark, sf):
    active = _runs(spark, sf).where("is_active")
    latest = rel.first_per_key(active, ["model_type"], [F.col("created_at"), F.col("model_version")])
    return latest.select("model_type", "model_version", "rmse", "r2", models.promotable(F.col("rmse"), F.col("r2")).alias("promote"))


@query("m16_scored_components", f"""
WITH s AS (SELECT entity_id, {WEIGHTED_SQL} AS score FROM entity_components),
d AS (SELECT entity_id, string_agg(metric, ', ' ORDER BY rank) AS drivers FROM (SELECT entity_id, metric, row_number() OVER (PARTITION BY entity_id ORDER BY abs(value - 50) DESC, metric) AS rank
  FROM component_long) WHERE rank <= 3 GROUP BY 1)
SELECT s.entity_id, round(score, 9) AS score, round(greatest(0, least(100, score)), 9) AS percentile, CASE WHEN score > 60 THEN 'high' WHEN score > 40 THEN 'moderate' ELSE 'low' END AS band,
  concat('Strongest contributing factors: ', drivers) AS insight FROM s JOIN d ON s.entity_id = d.entity_id
""", digits=9)
def scored_components(spark, sf):
    """Drivers are ranked inside the row: ten components, no shuffle."""
    names = list(fixed.COMPONENT_WEIGHTS)
    ranked = F.array_sort(F.array(*[F.struct((-F.abs(F.col(m) - 50)).alias("k"), F.lit(m).alias("m")) for m in names]))
    drivers = F.array_join(F.transform(F.slice(ranked, 1, 3), lambda x: x["m"]), ", ")
    score = agg.weighted_score()
    return st.entity_components(spark, sf).select(
        "entity_id", score.alias("score"), numeric.clamp(score, 0, 100).alias("percentile"), numeric.score_band(score).alias("band"),
        F.concat(F.lit("Strongest contributing factors: "), drivers).alias("insight"),
    )


@query("m17_performance_report", f"""WITH {RUNS_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY model_type ORDER BY created_at DESC, model_version DESC) AS rn, count(*) OVER (PARTITION BY model_type) AS n_runs FROM runs)
SELECT model_type, model_version, round(rmse, 6) AS rmse, round(r2, 6) AS r2, created_at, n_runs FROM a WHERE rn = 1
""")
def performance_report(spark, sf):
    runs = _runs(spark, sf)
    best = F.max_by(F.struct("model_version", "rmse", "r2", "created_at"), F.struct("created_at", "model_version")).alias("r")
    return runs.groupBy("model_type").agg(best, F.count("*").alias("n_runs")).select("model_type", "r.*", "n_runs")


@query("m18_active_entity_matrix", """
WITH a AS (SELECT mine_id, count(DISTINCT feature_date) AS n FROM gold_features WHERE feature_date >= (SELECT max(feature_date) FROM gold_features) - INTERVAL 30 DAY
  AND feature_freshness_score >= 0.7 GROUP BY 1 ORDER BY n DESC, mine_id LIMIT 50),
l AS (SELECT *, row_number() OVER (PARTITION BY mine_id ORDER BY feature_date DESC) AS rn FROM gold_features)
SELECT l.mine_id, production_mt AS x1, coalesce(esg_score, 0) AS x2, revenue AS x3, 0.0::DOUBLE AS x4 FROM l JOIN a ON l.mine_id = a.mine_id WHERE rn = 1
""")
def active_entity_matrix(spark, sf):
    return features.entity_matrix(st.gold_features(spark, sf), 50, ["production_mt", "esg_score", "revenue", "absent"])
