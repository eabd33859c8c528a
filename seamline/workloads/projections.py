"""Filters, projections and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from seamline import fixed
from seamline.functions import dates
from seamline.operators import relational as rel
from seamline.plans import formulas
from seamline.workloads import standins as st
from seamline.workloads.registry import query


@query("b01_equality_lookup", """
SELECT definition_id, title, sheet_name FROM metric_definitions WHERE sheet_name = '4 Emissions Score'
""")
def equality_lookup(spark, sf):
    found = rel.where_equal(st.metric_definitions(spark, sf), sheet_name="4 Emissions Score")
    return found.select("definition_id", "title", "sheet_name")


@query("b02_optional_terms", """
SELECT definition_id, sub_industry, country, year, raw_value FROM metric_values
WHERE sub_industry = 'BUILDING' AND year = 1997
""")
def optional_terms(spark, sf):
    found = rel.where_equal(st.metric_values(spark, sf), sub_industry="BUILDING", country=None, year=1997)
    return found.select("definition_id", "sub_industry", "country", "year", "raw_value")


@query("b03_date_range_and_freshness", """
SELECT mine_id, feature_date, feature_freshness_score, production_mt FROM gold_features
WHERE feature_date BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' AND feature_freshness_score >= 0.7
""")
def date_range_and_freshness(spark, sf):
    day = F.col("feature_date")
    since, until = dates.stamp("2024-01-05"), dates.stamp("2024-01-20")
    return (
        st.gold_features(spark, sf, since, until)
        .where(day.between(since, until))
        .where(F.col("feature_freshness_score") >= 0.7)
        .select("mine_id", "feature_date", "feature_freshness_score", "production_mt")
    )


@query("b04_rolling_lookback", """
SELECT event_id, user_id, ts, value FROM events
WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY
""")
def rolling_lookback(spark, sf):
    events = st.table(spark, sf, "events")
    return rel.where_since(events, "ts", 7, rel.latest_value(events, "ts")).select("event_id", "user_id", "ts", "value")


@query("b05_key_list", """
SELECT mine_id, feature_date, production_mt FROM gold_features
WHERE mine_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'FURNITURE')
""")
def key_list(spark, sf):
    keys = st.table(spark, sf, "customer").where("c_mktsegment = 'FURNITURE'").select(F.col("c_custkey").alias("mine_id"))
    return rel.where_keys_in(st.gold_features(spark, sf), "mine_id", keys).select("mine_id", "feature_date", "production_mt")


@query("b06_substring_ignoring_case", """
SELECT doc_id, source FROM documents WHERE text ILIKE '%ERTH%' OR source ILIKE '%SRC1%'
""")
def substring_ignoring_case(spark, sf):
    docs = st.table(spark, sf, "documents")
    return docs.where(F.col("text").ilike("%ERTH%") | F.col("source").ilike("%SRC1%")).select("doc_id", "source")


@query("b07_quality_and_relevance", """
SELECT d.doc_id, CAST(l.quality AS BIGINT) AS quality, d.lang FROM documents d
JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id
WHERE l.quality >= 0.7 AND e.embedding IS NOT NULL
  AND (d.lang = 'en' OR l.toxic = 1 OR d.n_chars > 2000 OR d.source = 'src3')
""")
def quality_and_relevance(spark, sf):
    vectors = st.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    relevant = (
        (F.col("lang") == "en") | (F.col("toxic") == 1) | (F.col("n_chars") > 2000) | (F.col("source") == "src3")
    )
    return (
        st.table(spark, sf, "documents").select("doc_id", "lang", "n_chars", "source")
        .join(st.table(spark, sf, "labels"), "doc_id")
        .join(vectors, "doc_id", "left")
        .where((F.col("quality") >= 0.7) & F.col("embedding").isNotNull() & relevant)
        .select("doc_id", "quality", "lang")
    )


@query("b08_drop_incomplete_rows", """
SELECT mine_id, feature_date, esg_score, production_mt FROM gold_features
WHERE esg_score IS NOT NULL AND production_mt IS NOT NULL
""")
def drop_incomplete_rows(spark, sf):
    rows = rel.drop_incomplete(st.gold_features(spark, sf), ["esg_score", "production_mt"])
    return rows.select("mine_id", "feature_date", "esg_score", "production_mt")


@query("b09_feature_names", """
SELECT mine_id, feature_date, production_mt AS f_production_volume, esg_score AS f_sustainability_score
FROM gold_features
""")
def feature_names(spark, sf):
    wanted = ["mine_id", "feature_date", "f_production_volume", "f_sustainability_score", "f_reserve_life_years"]
    return rel.rename_known(st.gold_features(spark, sf), fixed.FEATURE_NAMES, wanted)


@query("b10_columns_by_prefix", """
SELECT 100 * l_quantity * l_discount AS f_04_carbon_cost_exposure FROM lineitem
""")
def columns_by_prefix(spark, sf):
    """Keep the features of one sheet whose name starts with a given prefix."""
    frame = formulas.sheet_metrics(st.formula_inputs(spark, sf), "04")
    return frame.select(*rel.columns_with_prefix(frame, "f_04_carbon"))


@query("b11_load_metadata", """
SELECT event_id, value, 'events_feed' AS source_name, (SELECT max(ts) FROM events) AS ingest_date,
  strftime((SELECT max(ts) FROM events), '%Y-%m-%dT%H:%M:%S') AS data_version FROM events
""")
def load_metadata(spark, sf):
    events = st.table(spark, sf, "events")
    as_of = rel.latest_value(events, "ts")
    return events.select(
        "event_id", "value", F.lit("events_feed").alias("source_name"), as_of.alias("ingest_date"),
        F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss").alias("data_version"),
    )


@query("b12_types_by_suffix", """
SELECT event_id, CASE WHEN event_type <> 'view' THEN ts END AS event_date,
  CASE WHEN event_type <> 'error' THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) END AS k_value,
  value AS paid_amount FROM events
""")
def types_by_suffix(spark, sf):
    raw = st.table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_type") == "view", "not a date").otherwise(F.col("ts").cast("string")).alias("event_date"),
        F.when(F.col("event_type") == "error", "n/a").otherwise(F.regexp_extract("props", "([0-9]+)", 1)).alias("k_value"),
        F.col("value").cast("string").alias("paid_amount"),
    )
    return rel.type_by_suffix(raw)


@query("b13_unit_conversion", """
SELECT mine_id, feature_date, production_mt * 0.001 AS production_mt, capacity_mt FROM gold_features
""")
def unit_conversion(spark, sf):
    features = st.gold_features(spark, sf).select("mine_id", "feature_date", "production_mt", "capacity_mt")
    return rel.scale_columns(features, {"production_mt": 0.001, "absent_mt": 0.001})


@query("b14_drop_null_fields", """
SELECT definition_id, concat('{"title":"', title, '","data_quality":{', array_to_string(list_filter([
    CASE WHEN structured_availability IS NOT NULL THEN concat('"structured":', structured_availability) END,
    CASE WHEN volume_of_data IS NOT NULL THEN concat('"volume":', volume_of_data) END], lambda x: x IS NOT NULL), ','),
  '}', CASE WHEN readiness_status IS NOT NULL THEN concat(',"readiness":"', readiness_status, '"') ELSE '' END, '}') AS record
FROM metric_definitions
""")
def drop_null_fields(spark, sf):
    quality = F.struct(F.col("structured_availability").alias("structured"), F.col("volume_of_data").alias("volume"))
    record = F.struct("title", quality.alias("data_quality"), F.col("readiness_status").alias("readiness"))
    return st.metric_definitions(spark, sf).select("definition_id", F.to_json(record).alias("record"))


@query("b15_required_fields", """
SELECT definition_id, field FROM (
  SELECT definition_id, unnest(list_filter([
    CASE WHEN coalesce(trim(title), '') = '' THEN 'title' END,
    CASE WHEN coalesce(trim(readiness_status), '') = '' THEN 'readiness_status' END,
    CASE WHEN structured_availability IS NULL THEN 'structured_availability' END], lambda x: x IS NOT NULL)) AS field
  FROM metric_definitions)
""")
def required_fields(spark, sf):
    names = ["title", "readiness_status", "structured_availability"]
    missing = rel.missing_fields(**{n: F.col(n) for n in names})
    return st.metric_definitions(spark, sf).select("definition_id", F.explode(missing).alias("field"))


@query("b16_deployed_models", """
SELECT score_id AS run_id, sub_industry AS model_name, created_at FROM composite_scores WHERE horizon = 5
""")
def deployed_models(spark, sf):
    runs = st.composite_scores(spark, sf).withColumn("is_deployed", F.col("horizon") == 5)
    return rel.where_equal(runs, is_deployed=True).select(
        F.col("score_id").alias("run_id"), F.col("sub_industry").alias("model_name"), "created_at"
    )


@query("b17_recent_feed_view", """
SELECT event_type AS source, event_id AS record_id, props AS data, ts AS extracted_at,
  sha256(props)[1:16] AS provenance_hash FROM events
WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY
""")
def recent_feed_view(spark, sf):
    events = st.table(spark, sf, "events")
    recent = rel.where_since(events, "ts", 7, rel.latest_value(events, "ts"))
    return recent.select(
        F.col("event_type").alias("source"), F.col("event_id").alias("record_id"), F.col("props").alias("data"),
        F.col("ts").alias("extracted_at"), F.left(F.sha2("props", 256), F.lit(16)).alias("provenance_hash"),
    )
