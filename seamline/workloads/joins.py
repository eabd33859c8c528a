"""Joins and key lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from seamline import fixed
from seamline.functions import nested as nx
from seamline.functions import text as tx
from seamline.operators import relational as rel
from seamline.operators import segments
from seamline.operators import windows as win
from seamline.plans import features, retrieval
from seamline.workloads import standins as st
from seamline.workloads.registry import query


@query("j01_features_with_targets", """
WITH targets AS (SELECT mine_id, feature_date, feature_freshness_score - lag(feature_freshness_score)
    OVER (PARTITION BY mine_id ORDER BY feature_date) AS delta FROM gold_features)
SELECT g.mine_id, g.feature_date, g.production_mt, round(t.delta, 6) AS delta
FROM gold_features g JOIN targets t ON g.mine_id = t.mine_id AND g.feature_date = t.feature_date
WHERE t.delta IS NOT NULL
""")
def features_with_targets(spark, sf):
    gold = st.gold_features(spark, sf)
    targets = win.deltas(gold, "mine_id", "feature_date", "feature_freshness_score").select("mine_id", "feature_date", "delta")
    return gold.select("mine_id", "feature_date", "production_mt").join(targets, ["mine_id", "feature_date"])


@query("j02_definitions_with_values_and_source", """
SELECT md.definition_id, md.sheet_name, ds.name AS data_source_name, count(mv.raw_value) AS value_count
FROM metric_definitions md LEFT JOIN metric_values mv ON md.definition_id = mv.definition_id
LEFT JOIN data_sources ds ON md.source_id = ds.source_id GROUP BY 1, 2, 3
""")
def definitions_with_values_and_source(spark, sf):
    counts = st.metric_values(spark, sf).groupBy("definition_id").agg(F.count("raw_value").alias("value_count"))
    sources = st.data_sources(spark, sf).select("source_id", F.col("name").alias("data_source_name"))
    return (
        st.metric_definitions(spark, sf)
        .join(counts, "definition_id", "left")
        .join(sources, "source_id", "left")
        .select("definition_id", "sheet_name", "data_source_name", F.coalesce("value_count", F.lit(0)).alias("value_count"))
    )


@query("j03_latest_by_correlated_maximum", """
SELECT cs.score_id, cs.sub_industry, cs.country, cs.horizon, round(cs.score, 6) AS score, cs.created_at
FROM composite_scores cs WHERE cs.created_at = (SELECT max(c2.created_at) FROM composite_scores c2
  WHERE c2.sub_industry = cs.sub_industry AND c2.country = cs.country AND c2.horizon = cs.horizon)
""")
def latest_by_correlated_maximum(spark, sf):
    """The view as SQL; Catalyst turns the correlated maximum into an aggregate and a join."""
    return spark.sql(
        """
        SELECT score_id, sub_industry, country, horizon, score, created_at FROM {scores} cs
        WHERE created_at = (SELECT max(created_at) FROM {scores} c2 WHERE c2.sub_industry = cs.sub_industry
                            AND c2.country = cs.country AND c2.horizon = cs.horizon)
        """,
        scores=st.composite_scores(spark, sf),
    )


@query("j04_requested_entities", """
WITH latest AS (SELECT *, row_number() OVER (PARTITION BY mine_id ORDER BY feature_date DESC) AS rn FROM gold_features)
SELECT c_custkey AS mine_id, l.feature_date, l.production_mt, l.esg_score
FROM customer LEFT JOIN latest l ON c_custkey = l.mine_id AND l.rn = 1
""")
def requested_entities(spark, sf):
    """Every customer is asked for; entities without features come back empty."""
    requests = st.table(spark, sf, "customer").select(F.col("c_custkey").alias("mine_id"))
    gold = st.gold_features(spark, sf).select("mine_id", "feature_date", "production_mt", "esg_score")
    latest = rel.first_per_key(gold, ["mine_id"], [F.col("feature_date")])
    return rel.requested_rows(requests, latest, "mine_id")


CRAWL_HASH = """md5(concat('{"capacity": "', printf('%.2f', capacity), '", "country": "', country, '", "name": "', name, '"}'))"""


def _hashed(df):
    digest = nx.content_hash({
        "name": F.col("name"), "country": F.col("country"),
        "capacity": F.format_string("%.2f", "capacity"), "scraped_at": F.lit("now"),
    })
    return df.withColumn("content_hash", digest)


DIFF_SQL = f"""WITH a AS (SELECT name, country, {CRAWL_HASH} AS h FROM crawl_current),
b AS (SELECT name, country, {CRAWL_HASH} AS h FROM crawl_previous)
SELECT coalesce(a.name, b.name) AS name, coalesce(a.country, b.country) AS country, a.h AS current_hash, b.h AS previous_hash,
  CASE WHEN b.h IS NULL THEN 'new' WHEN a.h IS NULL THEN 'removed' WHEN a.h <> b.h THEN 'updated' ELSE 'unchanged' END AS status
FROM a FULL JOIN b ON a.name = b.name AND a.country = b.country"""


def _diff(spark, sf):
    return rel.snapshot_diff(
        _hashed(st.crawl_current(spark, sf)), _hashed(st.crawl_previous(spark, sf)), ["name", "country"], "content_hash"
    )


@query("j05_snapshot_diff", DIFF_SQL)
def snapshot_diff(spark, sf):
    return _diff(spark, sf)


@query("j06_snapshot_diff_summary", DIFF_SQL.replace("SELECT coalesce", ", d AS (SELECT coalesce", 1)
       + ") SELECT status, count(*) AS n FROM d GROUP BY status")
def snapshot_diff_summary(spark, sf):
    return _diff(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


@query("j07_rows_by_horizon", """
SELECT score_id, horizon_name, concat('s_', regexp_replace(lower(sub_industry), '[^a-z_]', '', 'g'), '_', horizon_name) AS score_name
FROM composite_scores, (VALUES ('H5'), ('H10'), ('H20')) h(horizon_name)
""")
def rows_by_horizon(spark, sf):
    rows = rel.with_each(st.composite_scores(spark, sf), "horizon_name", fixed.HORIZONS)
    return rows.select("score_id", "horizon_name", tx.score_name(F.col("sub_industry"), F.col("horizon_name")).alias("score_name"))


@query("j08_industry_by_country_grid", """
SELECT s.sub_industry, n_name AS country, 10::BIGINT AS horizon, round(avg(c.score), 6) AS mean_score, count(c.score) AS n
FROM (VALUES ('AUTOMOBILE'), ('BUILDING'), ('FURNITURE'), ('HOUSEHOLD'), ('MACHINERY')) s(sub_industry), nation
LEFT JOIN composite_scores c ON c.sub_industry = s.sub_industry AND c.country = n_name AND c.horizon = 10
GROUP BY 1, 2
""")
def industry_by_country_grid(spark, sf):
    """Requested sub-industries for every country, scored where there is data."""
    asked = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    grid = rel.with_each(st.nations(spark, sf).select(F.col("n_name").alias("country")), "sub_industry", asked)
    scored = (
        rel.where_equal(st.composite_scores(spark, sf), horizon=10)
        .groupBy("sub_industry", "country")
        .agg(F.avg("score").alias("mean_score"), F.count("score").alias("n"))
    )
    return grid.join(scored, ["sub_industry", "country"], "left").select(
        "sub_industry", "country", F.lit(10).cast("bigint").alias("horizon"), "mean_score",
        F.coalesce("n", F.lit(0)).alias("n"),
    )


@query("j09_positional_zip", """
WITH c AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS words,
    list_filter(regexp_split_to_array(text, '\\.'), lambda x: x <> '') AS parts FROM documents),
z AS (SELECT doc_id, words, parts, unnest(range(0, least(len(words), len(parts)))) AS i FROM c)
SELECT doc_id, i::BIGINT AS position, words[i + 1] AS left_item, parts[i + 1] AS right_item FROM z
""")
def positional_zip(spark, sf):
    """Two lists side by side, as long as the shorter one."""
    docs = st.table(spark, sf, "documents")
    left = F.filter(F.split("text", r"[ \t\n\r\f\x0b]+"), lambda x: x != "")
    right = F.filter(F.split("text", r"\."), lambda x: x != "")
    return retrieval.zip_positions(docs.select("doc_id", left.alias("a"), right.alias("b")), "a", "b").select(
        "doc_id", "position", F.col("a").alias("left_item"), F.col("b").alias("right_item")
    )


@query("j10_point_in_time_lookup", """
WITH asks AS (SELECT event_id, user_id AS mine_id, ts AS asked_at FROM events WHERE event_type = 'purchase')
SELECT a.event_id, a.mine_id, a.asked_at,
  CASE WHEN g.feature_date >= a.asked_at - INTERVAL 7 DAY THEN g.feature_date END AS feature_ts,
  CASE WHEN g.feature_date >= a.asked_at - INTERVAL 7 DAY THEN g.production_mt END AS production_mt,
  CASE WHEN g.feature_date >= a.asked_at - INTERVAL 7 DAY THEN g.esg_score END AS esg_score
FROM asks a ASOF LEFT JOIN gold_features g ON a.mine_id = g.mine_id AND a.asked_at >= g.feature_date
""")
def point_in_time_lookup(spark, sf):
    asks = st.table(spark, sf, "events").where("event_type = 'purchase'").select(
        "event_id", F.col("user_id").alias("mine_id"), F.col("ts").alias("asked_at")
    )
    gold = st.gold_features(spark, sf)
    return segments.as_of_join(asks, gold, "mine_id", "asked_at", "feature_date", ["production_mt", "esg_score"], ttl_days=7)


@query("j10_point_in_time_lookup_country", """
WITH feats AS (SELECT e.country_code, g.feature_date, round(sum(g.production_mt), 4) AS country_production
    FROM gold_features g JOIN entity_country e ON g.mine_id = e.mine_id GROUP BY 1, 2),
asks AS (SELECT o_orderkey, n_name AS country_code, o_orderdate + INTERVAL 10000 DAY AS asked_at
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT a.o_orderkey, a.country_code, a.asked_at,
  CASE WHEN f.feature_date >= a.asked_at - INTERVAL 30 DAY THEN f.feature_date END AS feature_ts,
  CASE WHEN f.feature_date >= a.asked_at - INTERVAL 30 DAY THEN f.country_production END AS country_production
FROM asks a ASOF LEFT JOIN feats f ON a.country_code = f.country_code AND a.asked_at >= f.feature_date
""")
def point_in_time_lookup_country(spark, sf):
    """Country features, valid for 30 days, looked up for shifted order dates."""
    feats = features.country_features(st.gold_features(spark, sf), st.entity_country(spark, sf)).select(
        "country_code", "feature_date", "country_production"
    )
    asks = st.table(spark, sf, "orders").join(
        st.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")
    ).join(st.nations(spark, sf), F.col("c_nationkey") == F.col("n_nationkey")).select(
        "o_orderkey", F.col("n_name").alias("country_code"),
        (F.col("o_orderdate") + F.make_dt_interval(F.lit(10000))).alias("asked_at"),
    )
    return segments.as_of_join(asks, feats, "country_code", "asked_at", "feature_date", ["country_production"], ttl_days=30)


SHEET_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.SHEET_NUMBERS.items())
THEME_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.SHEET_THEMES.items())


@query("j11_sheet_numbers_and_themes", f"""
SELECT definition_id, sheet_name, CASE sheet_name {SHEET_SQL} ELSE '00' END AS sheet_number,
  CASE sheet_name {THEME_SQL} ELSE 'Unknown' END AS theme FROM metric_definitions
""")
def sheet_numbers_and_themes(spark, sf):
    name = F.col("sheet_name")
    return st.metric_definitions(spark, sf).select(
        "definition_id", "sheet_name", tx.sheet_number(name).alias("sheet_number"), tx.sheet_theme(name).alias("theme")
    )
