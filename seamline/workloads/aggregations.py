"""Grouped and whole-frame summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from seamline import fixed
from seamline.functions import dates
from seamline.functions import text as tx
from seamline.operators import aggregates as agg
from seamline.operators import relational as rel
from seamline.operators import segments
from seamline.operators import windows as win
from seamline.plans import features, retrieval
from seamline.workloads import standins as st
from seamline.workloads.registry import query

#: Rows of the largest table that one task joins and groups.
TASK_ROWS = 500_000
SUMMARY = ["definition_id", "sheet_name", "title", "readiness_status", "data_source_name", "value_count",
           "industry_count", "country_count", "earliest_year", "latest_year", "avg_normalized_value"]


@query("g01_metric_summary", """
SELECT md.definition_id, md.sheet_name, md.title, md.readiness_status, ds.name AS data_source_name,
  count(mv.raw_value) AS value_count, count(DISTINCT mv.sub_industry) AS industry_count,
  count(DISTINCT mv.country) AS country_count, min(mv.year) AS earliest_year, max(mv.year) AS latest_year,
  round(avg(mv.normalized_value), 6) AS avg_normalized_value
FROM metric_definitions md LEFT JOIN metric_values mv ON md.definition_id = mv.definition_id
LEFT JOIN data_sources ds ON md.source_id = ds.source_id GROUP BY 1, 2, 3, 4, 5
""")
def metric_summary(spark, sf):
    tasks = max(1, -(-st.table(spark, sf, "lineitem").count() // TASK_ROWS))
    summary = agg.metric_summary(st.metric_definitions(spark, sf), st.metric_values(spark, sf, tasks), st.data_sources(spark, sf), tasks=tasks)
    return summary.select(*SUMMARY)


@query("g02_embedding_coverage", """
SELECT count(*) AS total, count(e.embedding) AS present, round(count(e.embedding) / count(*), 6) AS coverage
FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id
""")
def embedding_coverage(spark, sf):
    vectors = st.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return agg.coverage(st.table(spark, sf, "documents").select("doc_id").join(vectors, "doc_id", "left"), "embedding")


@query("g03_metrics_by_sheet", """
SELECT coalesce(sheet_name, 'TOTAL') AS sheet_name, count(*) AS n FROM metric_definitions GROUP BY ROLLUP (sheet_name)
""")
def metrics_by_sheet(spark, sf):
    counts = st.metric_definitions(spark, sf).rollup("sheet_name").agg(F.count("*").alias("n"))
    return counts.select(F.coalesce("sheet_name", F.lit("TOTAL")).alias("sheet_name"), "n")


@query("g04_weight_spread", """
SELECT metric, count(value) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS minimum,
  round(max(value), 6) AS maximum, round(stddev_pop(value), 6) AS std FROM component_long GROUP BY metric
""")
def weight_spread(spark, sf):
    return agg.spread(st.component_long(spark, sf), "value", ["metric"])


@query("g05_regression_quality", """
WITH p AS (SELECT CASE WHEN l_shipdate < TIMESTAMP '2000-01-01' THEN 'train' ELSE 'validation' END AS part,
   l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem)
SELECT part, count(*) AS n, round(sqrt(avg((y - p) ** 2)), 4) AS rmse,
  round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 4) AS r2, round(avg(abs(y - p)), 4) AS mae FROM p GROUP BY part
""", digits=4)
def regression_quality(spark, sf):
    scored = st.table(spark, sf, "lineitem").select(
        F.when(F.col("l_shipdate") < dates.stamp("2000-01-01"), "train").otherwise("validation").alias("part"),
        F.col("l_extendedprice").alias("actual"), (F.col("l_quantity") * 1500).alias("predicted"),
    )
    return agg.regression_quality(scored, "actual", "predicted", ["part"])


@query("g06_entity_totals", """
SELECT mine_id, round(sum(production_mt), 4) AS total_production, count(*) AS n,
  round(avg(feature_freshness_score), 9) AS mean_trust, round(avg(esg_score) * 100, 9) AS mean_quality
FROM gold_features GROUP BY mine_id
""", digits={"total_production": 4, "mean_trust": 9, "mean_quality": 9})
def entity_totals(spark, sf):
    return st.gold_features(spark, sf).groupBy("mine_id").agg(
        F.sum("production_mt").alias("total_production"), F.count("*").alias("n"),
        F.avg("feature_freshness_score").alias("mean_trust"), (F.avg("esg_score") * 100).alias("mean_quality"),
    )


@query("g07_fleet_summary", """
SELECT count(*) AS total, count(*) FILTER (lower(readiness_status) = 'complete') AS active,
  (SELECT count(DISTINCT p_type) FROM part) AS commodities, round(sum(weighting), 2) AS capacity
FROM metric_definitions
""", digits=2)
def fleet_summary(spark, sf):
    return st.table(spark, sf, "part").agg(
        F.count("*").alias("total"),
        F.count_if(F.lower(F.when(F.col("p_size") % 3 == 0, "Complete")) == "complete").alias("active"),
        F.count_distinct("p_type").alias("commodities"),
        F.sum("p_retailprice").alias("capacity"),
    )


@query("g08_count_per_commodity", "SELECT p_type AS commodity, count(*) AS n FROM part GROUP BY 1")
def count_per_commodity(spark, sf):
    return st.table(spark, sf, "part").groupBy(F.col("p_type").alias("commodity")).agg(F.count("*").alias("n"))


DELTAS = """SELECT mine_id, feature_date, feature_freshness_score, prev AS previous_value,
    round(feature_freshness_score - prev, 9) AS delta FROM (SELECT *, lag(feature_freshness_score)
    OVER (PARTITION BY mine_id ORDER BY feature_date) AS prev FROM gold_features) WHERE prev IS NOT NULL"""


def _deltas(spark, sf, **options):
    return win.deltas(st.gold_features(spark, sf), "mine_id", "feature_date", "feature_freshness_score", **options)


@query("g09_recent_change_summary", f"""
WITH d AS ({DELTAS} ORDER BY feature_date DESC, mine_id LIMIT 10)
SELECT count(*) FILTER (delta > 0) AS increases, count(*) FILTER (delta < 0) AS decreases,
  round(sum(abs(delta)), 6) AS total_change, round(sum(feature_freshness_score), 6) AS total_gain FROM d
""")
def recent_change_summary(spark, sf):
    recent = _deltas(spark, sf).orderBy(F.col("feature_date").desc(), "mine_id").limit(10)
    return recent.agg(
        F.count_if(F.col("delta") > 0).alias("increases"), F.count_if(F.col("delta") < 0).alias("decreases"),
        F.sum("abs_delta").alias("total_change"), F.sum("feature_freshness_score").alias("total_gain"),
    )


@query("g10_data_quality_bands", """
WITH q AS (SELECT mine_id, (avg(feature_freshness_score) + avg(CASE WHEN esg_score IS NULL THEN 0.0 ELSE 1.0 END)
   + avg(CASE WHEN revenue > 0 THEN 1.0 ELSE 0.0 END) + avg(CASE WHEN carbon > 0 THEN 1.0 ELSE 0.0 END)
   + avg(CASE WHEN operating_cost > 0 THEN 1.0 ELSE 0.0 END)) / 5 AS overall FROM gold_features GROUP BY 1)
SELECT mine_id, round(overall, 6) AS overall, CASE WHEN round(overall, 9) >= 0.9 THEN 'Excellent' WHEN round(overall, 9) >= 0.7 THEN 'Good'
  ELSE 'Needs Improvement' END AS band FROM q
""")
def data_quality_bands(spark, sf):
    share = lambda hit: F.avg(F.when(hit, 1.0).otherwise(0.0))
    dims = st.gold_features(spark, sf).groupBy("mine_id").agg(
        F.avg("feature_freshness_score").alias("freshness"), share(F.col("esg_score").isNotNull()).alias("completeness"),
        share(F.col("revenue") > 0).alias("validity"), share(F.col("carbon") > 0).alias("consistency"),
        share(F.col("operating_cost") > 0).alias("accuracy"),
    )
    return dims.select("mine_id", *agg.data_quality(["freshness", "completeness", "validity", "consistency", "accuracy"]))


@query("g11_delta_summary", f"""
WITH d AS ({DELTAS}) SELECT count(*) AS total_changes, round(avg(delta), 6) AS avg_delta,
  round(max(delta), 6) AS max_increase, round(min(delta), 6) AS max_decrease FROM d
""")
def delta_summary(spark, sf):
    return _deltas(spark, sf).agg(
        F.count("*").alias("total_changes"), F.avg("delta").alias("avg_delta"),
        F.max("delta").alias("max_increase"), F.min("delta").alias("max_decrease"),
    )


TOPICS_SQL = "list_filter([" + ", ".join(
    f"CASE WHEN role = 'user' AND contains(lower(text), '{k}') THEN '{t}' END" for k, t in fixed.TOPIC_KEYWORDS.items()
) + "], lambda x: x IS NOT NULL)"


@query("g12_conversation_summary", f"""
SELECT conv_id, count(*) AS total_messages, count(*) FILTER (role = 'user') AS user_messages,
  count(*) FILTER (role = 'assistant') AS assistant_messages,
  round(coalesce(avg(nullif(response_ms, 0)), 0), 6) AS avg_response_ms,
  array_to_string(list_sort(list_distinct(flatten(list({TOPICS_SQL})))), ', ') AS topics
FROM messages GROUP BY conv_id
""")
def conversation_summary(spark, sf):
    return agg.session_summary(st.messages(spark, sf), "conv_id", "role", "response_ms", tx.topics(F.col("text")))


@query("g13_most_active_entities", """
SELECT mine_id, count(DISTINCT feature_date) AS active_days FROM gold_features
WHERE feature_date >= (SELECT max(feature_date) FROM gold_features) - INTERVAL 30 DAY AND feature_freshness_score >= 0.7
GROUP BY mine_id ORDER BY active_days DESC, mine_id LIMIT 20
""")
def most_active_entities(spark, sf):
    gold = st.gold_features(spark, sf, st.days_before_latest(spark, sf, 30))
    return features.most_active(gold, 20, as_of=st.days_before_latest(spark, sf, 0))


@query("g14_ingestion_summary", """
WITH d AS (SELECT CASE WHEN trim(text) <> '' THEN 'processed' ELSE 'failed' END AS status,
  len(list_filter(regexp_split_to_array(text, '{BLANK}+'), lambda x: x <> '')) AS n_words FROM documents)
SELECT status, count(*) AS files, CAST(sum(CAST(ceil(n_words / 462.0) AS BIGINT)) AS BIGINT) AS chunks FROM d GROUP BY status
""")
def ingestion_summary(spark, sf):
    docs = st.documents(spark, sf).select(
        F.when(F.trim("text") != "", "processed").otherwise("failed").alias("status"),
        F.size(retrieval.word_chunks(F.col("text"))).alias("chunks"),
    )
    return docs.groupBy("status").agg(F.count("*").alias("files"), F.sum("chunks").alias("chunks"))


@query("g15_country_features", """
SELECT country_code, feature_date, round(sum(production_mt), 4) AS country_production,
  round(avg(esg_score), 6) AS country_esg, round(avg(incidents * 1000 / n_events), 6) AS country_safety,
  round(avg(carbon / nullif(production_mt, 0)), 6) AS country_carbon_intensity
FROM gold_features g JOIN entity_country e ON g.mine_id = e.mine_id GROUP BY 1, 2
""")
def country_features(spark, sf):
    return features.country_features(st.gold_features(spark, sf), st.entity_country(spark, sf))


@query("g16_dataset_profile", """
SELECT count(*) AS row_count, 'mine_id' AS column_name, 'bigint' AS column_type, count(*) FILTER (mine_id IS NULL) AS null_count FROM gold_features
UNION ALL SELECT count(*), 'esg_score', 'double', count(*) FILTER (esg_score IS NULL) FROM gold_features
UNION ALL SELECT count(*), 'production_mt', 'double', count(*) FILTER (production_mt IS NULL) FROM gold_features
UNION ALL SELECT count(*), 'feature_date', 'timestamp', count(*) FILTER (feature_date IS NULL) FROM gold_features
""")
def dataset_profile(spark, sf):
    return agg.null_profile(st.gold_features(spark, sf).select("mine_id", "esg_score", "production_mt", "feature_date"))


WEIGHTED_SQL = " + ".join(f"{m} * {w}" for m, w in fixed.COMPONENT_WEIGHTS.items())


@query("g17_composite_score", f"SELECT entity_id, round({WEIGHTED_SQL}, 9) AS score FROM entity_components", digits=9)
def composite_score(spark, sf):
    return st.entity_components(spark, sf).select("entity_id", agg.weighted_score().alias("score"))


@query("g18_percentile_summary", """
SELECT sub_industry, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std,
  round(quantile_cont(score, 0.05), 6) AS p05, round(quantile_cont(score, 0.25), 6) AS p25,
  round(quantile_cont(score, 0.75), 6) AS p75, round(quantile_cont(score, 0.95), 6) AS p95
FROM composite_scores GROUP BY sub_industry
""")
def percentile_summary(spark, sf):
    return agg.percentile_summary(st.composite_scores(spark, sf), "score", ["sub_industry"])


@query("g19_median_fill", """
SELECT event_id, round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM gappy)), 6) AS filled FROM gappy
""")
def median_fill(spark, sf):
    return win.fill_missing(st.gappy(spark, sf), "value", "median", "filled").select("event_id", "filled")


@query("g20_mean_fill", """
SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM gappy)), 6) AS filled FROM gappy
""")
def mean_fill(spark, sf):
    return win.fill_missing(st.gappy(spark, sf), "value", "mean", "filled").select("event_id", "filled")


@query("g21_group_effects", """
SELECT sub_industry, count(*) AS n, round(avg(score) - (SELECT avg(score) FROM composite_scores), 6) AS effect_mean,
  round(stddev_samp(score) / sqrt(count(*)), 6) AS effect_std FROM composite_scores GROUP BY 1
""")
def group_effects(spark, sf):
    scores = st.composite_scores(spark, sf)
    grand = scores.agg(F.avg("score")).scalar()
    groups = scores.groupBy("sub_industry").agg(
        F.count("*").alias("n"), F.avg("score").alias("m"), F.stddev_samp("score").alias("s")
    )
    return groups.select(
        "sub_industry", "n", (F.col("m") - grand).alias("effect_mean"), (F.col("s") / F.sqrt("n")).alias("effect_std")
    )


@query("g22_validity_rollup", """
WITH v AS (SELECT regexp_matches(raw_slug, '^[a-z_]+$') AS slug_ok, structured_availability IS NOT NULL AS grade_ok FROM metric_definitions)
SELECT count(*) AS total, count(*) FILTER (slug_ok) AS valid_slugs, count(*) FILTER (grade_ok) AS valid_grades,
  count(*) FILTER (slug_ok AND grade_ok) AS success FROM v
""")
def validity_rollup(spark, sf):
    slug_ok, grade_ok = F.col("raw_slug").rlike("^[a-z_]+$"), F.col("structured_availability").isNotNull()
    return st.metric_definitions(spark, sf).agg(
        F.count("*").alias("total"), F.count_if(slug_ok).alias("valid_slugs"), F.count_if(grade_ok).alias("valid_grades"),
        F.count_if(slug_ok & grade_ok).alias("success"),
    )


@query("g23_prediction_rollup", """
SELECT sub_industry, round(avg(score) , 6) AS mean_prediction, round(avg(greatest(0.1, least(1.0, 1 - abs(score / 100) / 2))), 6) AS mean_confidence
FROM composite_scores GROUP BY 1
""")
def prediction_rollup(spark, sf):
    p = F.col("score") / 100
    confidence = F.greatest(F.lit(0.1), F.least(F.lit(1.0), 1 - F.abs(p) / 2))
    return st.composite_scores(spark, sf).groupBy("sub_industry").agg(
        (F.avg(p) * 100).alias("mean_prediction"), F.avg(confidence).alias("mean_confidence")
    )


@query("g24_hit_ratio", """
SELECT user_id, round(count(*) FILTER (event_type = 'view') / count(*), 6) AS hit_ratio FROM events GROUP BY user_id
""")
def hit_ratio(spark, sf):
    return st.table(spark, sf, "events").groupBy("user_id").agg(agg.ratio(F.col("event_type") == "view").alias("hit_ratio"))


@query("g25_overall_card", """
SELECT count(*) AS n, round(avg(feature_freshness_score), 6) AS mean_trust, round(avg(esg_score), 6) AS mean_quality FROM gold_features
""")
def overall_card(spark, sf):
    return st.gold_features(spark, sf).agg(
        F.count("*").alias("n"), F.avg("feature_freshness_score").alias("mean_trust"), F.avg("esg_score").alias("mean_quality")
    )
