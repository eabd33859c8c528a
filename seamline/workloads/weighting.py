"""Metric weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from seamline import fixed
from seamline.operators import aggregates as agg
from seamline.operators import relational as rel
from seamline.plans import features, formulas, weights
from seamline.session import cut_lineage
from seamline.workloads import standins as st
from seamline.workloads.metrics import _cells, _rounded
from seamline.workloads.registry import query

FEATURES = ["f_01_economic_criticality", "f_03_subsidy_factor", "f_04_co2_intensity", "f_09_repurposing_potential", "f_11_hhi_dominance"]
FRAME_SQL = f"frame AS (SELECT l_extendedprice AS target, {_cells(FEATURES)} FROM (SELECT f.*, Market_price AS l_extendedprice FROM formula_inputs f))"
QUALITY_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS metric, CASE WHEN count({c}) = 0 THEN 0 ELSE 0.4 + 0.3 * count({c}) / count(*) + 0.3 / (1 + CASE WHEN avg({c}) = 0 THEN 0 ELSE stddev_pop({c}) / avg({c}) END) END AS quality FROM frame"""
    for c in FEATURES
)


def gain_sql(features, target, frame):
    """SQL twin of the binned information gain."""
    long = " UNION ALL ".join(
        f"""SELECT '{c}' AS metric, coalesce(least(CAST(floor((x - min(x) OVER ()) / nullif(max(x) OVER () - min(x) OVER (), 0) * 10) AS INTEGER), 9), 0) AS x,
  coalesce(least(CAST(floor((y - min(y) OVER ()) / nullif(max(y) OVER () - min(y) OVER (), 0) * 10) AS INTEGER), 9), 0) AS y
  FROM (SELECT coalesce(CAST({c} AS DOUBLE), 0) AS x, coalesce({target}, avg({target}) OVER ()) AS y FROM {frame})"""
        for c in features
    )
    return f"""cells AS ({long}), joint AS (SELECT metric, x, y, count(*) AS n FROM cells GROUP BY 1, 2, 3),
margins AS (SELECT *, sum(n) OVER (PARTITION BY metric, x) AS nx, sum(n) OVER (PARTITION BY metric, y) AS ny, sum(n) OVER (PARTITION BY metric) AS total FROM joint),
raw AS (SELECT metric, greatest(sum(n / total * ln(CAST(n AS DOUBLE) * total / (CAST(nx AS DOUBLE) * ny))), 0) AS raw_gain FROM margins GROUP BY metric),
gains AS (SELECT metric, raw_gain, CASE WHEN max(raw_gain) OVER () > 0 THEN raw_gain / max(raw_gain) OVER () ELSE raw_gain END AS gain FROM raw)"""


GAIN_SQL = gain_sql(FEATURES, "target", "frame")


def _frame(spark, sf):
    """Features rounded like the twin, so that both fall into the same bins.

    Written once: ranges, histogram and qualities read these few columns and not the formulas' inputs.
    """
    frame = formulas.with_formulas(st.formula_inputs(spark, sf), {k: v for k, v in formulas.catalogue().items() if k in FEATURES})
    return cut_lineage(frame.select(F.col("Market_price").alias("target"), *_rounded(FEATURES)))


@query("w01_quality_weights", f"WITH {FRAME_SQL}, q AS ({QUALITY_SQL}) SELECT metric, round(quality, 6) AS quality FROM q")
def quality_weights(spark, sf):
    return weights.quality_weights(_frame(spark, sf), FEATURES)


@query("w02_information_gain", f"WITH {FRAME_SQL}, {GAIN_SQL} SELECT metric, round(raw_gain, 6) AS raw_gain, round(gain, 6) AS gain FROM gains")
def information_gain(spark, sf):
    return weights.information_gain(_frame(spark, sf), FEATURES, "target")


BASE = {"f_03_subsidy_factor": 0.5, "f_04_co2_intensity": 2.0}
BASE_SQL = "CASE metric " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in BASE.items()) + " ELSE 1.0 END::DOUBLE"
COMBINED_SQL = f"""{FRAME_SQL}, {GAIN_SQL}, quality AS ({QUALITY_SQL}),
combined AS (SELECT q.metric, concat('w_', substring(q.metric, 3), '_H10') AS weight_name, {BASE_SQL.replace('metric', 'q.metric')} AS base, quality, gain,
  {BASE_SQL.replace('metric', 'q.metric')} * (0.5 * quality + 0.5 * gain) AS weight FROM quality q JOIN gains g ON q.metric = g.metric)"""


def _combined(spark, sf):
    frame = _frame(spark, sf)
    base = spark.createDataFrame([(f, BASE.get(f)) for f in FEATURES], "metric string, base double")
    return weights.combine(base, weights.quality_weights(frame, FEATURES), weights.information_gain(frame, FEATURES, "target"), "H10")


@query("w03_combined_weights", f"""WITH {COMBINED_SQL} SELECT metric, weight_name, round(base, 6) AS base, round(quality, 6) AS quality, round(gain, 6) AS gain, round(weight, 6) AS weight FROM combined""")
def combined_weights(spark, sf):
    return _combined(spark, sf)


OVERRIDES = [("w_03_subsidy_factor_H10", 0.25), ("w_99_unknown_H10", 9.0)]


def _overridden(spark, sf):
    changes = spark.createDataFrame(OVERRIDES, "weight_name string, weight double")
    return weights.override(_combined(spark, sf), changes)


@query("w04_overridden_weights", f"""WITH {COMBINED_SQL} SELECT weight_name, round(CASE WHEN weight_name = 'w_03_subsidy_factor_H10' THEN 0.25 ELSE weight END, 6) AS weight FROM combined""")
def overridden_weights(spark, sf):
    return _overridden(spark, sf).select("weight_name", "weight")


@query("w05_unit_sum_weights", """
SELECT entity_id, metric, round(CASE WHEN sum(value) OVER w = 0 THEN value ELSE value / sum(value) OVER w END, 6) AS value
FROM component_long WINDOW w AS (PARTITION BY entity_id)
""")
def unit_sum_weights(spark, sf):
    return weights.to_unit_sum(st.component_long(spark, sf), "value", ["entity_id"])


MEAN_GAINS_SQL = "mean_gains AS (SELECT metric, avg(value) / 100 AS gain FROM component_long GROUP BY metric)"


def _mean_gains(spark, sf):
    return st.component_long(spark, sf).groupBy("metric").agg((F.avg("value") / 100).alias("gain"))


@query("w06_smoothed_weights", f"""WITH {MEAN_GAINS_SQL}
SELECT metric, coalesce(weight_value, 0.5) AS old_weight, round(gain, 6) AS gain,
  round(greatest(0.1, least(1.0, 0.8 * coalesce(weight_value, 0.5) + 0.2 * gain)), 6) AS new_weight
FROM mean_gains LEFT JOIN active_weights ON metric = metric_slug
""")
def smoothed_weights(spark, sf):
    return weights.smoothed(_mean_gains(spark, sf), st.active_weights(spark))


@query("w07_requested_weights", """
WITH asked AS (SELECT DISTINCT metric AS metric_slug FROM component_long)
SELECT a.metric_slug, coalesce(weight_value, 0.5) AS weight_value FROM asked a LEFT JOIN active_weights w ON a.metric_slug = w.metric_slug
""")
def requested_weights(spark, sf):
    slugs = st.component_long(spark, sf).select(F.col("metric").alias("metric_slug")).distinct()
    return weights.requested(slugs, st.active_weights(spark))


# Feature column -> how it follows from the gold columns, the same text for both engines.
GOLD_FEATURES = {
    "production_mt": "production_mt", "capacity_utilization_rate": "production_mt / nullif(capacity_mt, 0)", "esg_score": "esg_score",
    "carbon_intensity_tco2_per_mt": "carbon / nullif(production_mt, 0)", "revenue_per_mt": "revenue / nullif(production_mt, 0)",
    "operating_margin": "(revenue - operating_cost) / nullif(revenue, 0)", "safety_incident_rate_per_1000_employees": "CAST(incidents AS DOUBLE)",
    "reserve_life_years": "reserves / nullif(production_mt, 0)", "total_carbon_emissions_tco2": "carbon",
    "productivity_mt_per_employee": "production_mt / CAST(n_events AS DOUBLE)", "metric_year": "CAST(year(feature_date) AS DOUBLE)",
    "metric_quarter": "CAST(quarter(feature_date) AS DOUBLE)", "metric_month": "CAST(month(feature_date) AS DOUBLE)",
}
LOOKBACK = 14
FILLED_SQL = f"""recent AS (SELECT *, {', '.join(f'{e} AS x_{c}' for c, e in GOLD_FEATURES.items())} FROM gold_features WHERE feature_date >= (SELECT max(feature_date) FROM gold_features) - INTERVAL {LOOKBACK} DAY),
deltas AS (SELECT *, abs(round(feature_freshness_score - lag(feature_freshness_score) OVER (PARTITION BY mine_id ORDER BY feature_date), 9)) AS delta FROM recent),
kept AS (SELECT * FROM deltas WHERE delta IS NOT NULL AND feature_freshness_score >= 0.7),
filled AS (SELECT delta, {', '.join(f'coalesce(x_{c}, (SELECT quantile_cont(x_{c}, 0.5) FROM kept), 0) AS {c}' for c in GOLD_FEATURES)} FROM kept),
slugs AS (SELECT unnest({list(fixed.METRIC_SLUGS)}) AS metric, unnest({list(fixed.METRIC_SLUGS.values())}) AS slug)"""


@query("w08_gain_by_feature", f"""WITH {FILLED_SQL}, {gain_sql(GOLD_FEATURES, 'delta', 'filled')}
SELECT coalesce(slug, gains.metric) AS metric, round(raw_gain, 6) AS raw_gain, round(gain, 6) AS gain FROM gains LEFT JOIN slugs ON gains.metric = slugs.metric""")
def gain_by_feature(spark, sf):
    since = st.days_before_latest(spark, sf, LOOKBACK)
    gold = st.gold_features(spark, sf, since).select(
        "mine_id", "feature_date", "feature_freshness_score", *[F.expr(e).cast("double").alias(c) for c, e in GOLD_FEATURES.items()]
    )
    return weights.gain_by_feature(gold, list(GOLD_FEATURES), "feature_freshness_score", since)


@query("w09_weight_report", f"""WITH {MEAN_GAINS_SQL}
SELECT count(*) AS n, round(avg(gain), 6) AS mean, round(min(gain), 6) AS minimum, round(max(gain), 6) AS maximum, round(stddev_pop(gain), 6) AS std,
  max_by(metric, gain - coalesce(weight_value, 0.5)) AS top_increase, min_by(metric, gain - coalesce(weight_value, 0.5)) AS top_decrease
FROM mean_gains LEFT JOIN active_weights ON metric = metric_slug
""")
def weight_report(spark, sf):
    changed = weights.changes(_mean_gains(spark, sf), st.active_weights(spark))
    return changed.agg(
        F.count("gain").alias("n"), F.avg("gain").alias("mean"), F.min("gain").alias("minimum"), F.max("gain").alias("maximum"),
        F.stddev_pop("gain").alias("std"), F.max_by("metric", "change").alias("top_increase"), F.min_by("metric", "change").alias("top_decrease"),
    )


@query("w10_horizon_weights", f"""WITH {MEAN_GAINS_SQL}
SELECT metric, h AS horizon, concat('w_', metric, '_', h) AS weight_name, round(gain, 6) AS weight FROM mean_gains, (VALUES ('H5'), ('H10'), ('H20')) t(h)
""")
def horizon_weights(spark, sf):
    return weights.by_horizon(_mean_gains(spark, sf).withColumnRenamed("gain", "weight"))


@query("w11_weight_job", f"""WITH {COMBINED_SQL}, o AS (SELECT *, CASE WHEN weight_name = 'w_03_subsidy_factor_H10' THEN 0.25 ELSE weight END AS final FROM combined)
SELECT weight_name, round(base, 6) AS base, round(quality, 6) AS quality, round(gain, 6) AS gain, round(final, 6) AS weight,
  round(final / sum(final) OVER (), 6) AS normalised FROM o
""")
def weight_job(spark, sf):
    final = _overridden(spark, sf).withColumn("normalised", F.col("weight"))
    return weights.to_unit_sum(final, "normalised").select("weight_name", "base", "quality", "gain", "weight", "normalised")


@query("w12_weight_history", """
WITH v AS (SELECT metric, feature_date, round(avg(v), 9) AS w FROM (UNPIVOT (SELECT feature_date, production_mt, revenue, carbon FROM gold_features)
  ON production_mt, revenue, carbon INTO NAME metric VALUE v) GROUP BY 1, 2),
h AS (SELECT *, lag(w) OVER (PARTITION BY metric ORDER BY feature_date) AS old FROM v)
SELECT metric, feature_date, round(old, 6) AS old_weight, round(w, 6) AS new_weight, round(w - old, 6) AS change FROM h WHERE old IS NOT NULL
""")
def weight_history(spark, sf):
    long = st.gold_features(spark, sf).unpivot("feature_date", ["production_mt", "revenue", "carbon"], "metric", "v")
    versions = long.groupBy("metric", "feature_date").agg(F.round(F.avg("v"), 9).alias("w"))
    return weights.history(versions, "metric", "feature_date", "w")
