"""Ordered and partition-relative computations."""

from __future__ import annotations

from pyspark.sql import functions as F

from seamline import fixed
from seamline.operators import relational as rel
from seamline.operators import windows as win
from seamline.plans import conversations
from seamline.workloads import standins as st
from seamline.workloads.aggregations import DELTAS, _deltas
from seamline.workloads.registry import query


@query("e01_score_deltas", f"""
WITH d AS ({DELTAS}) SELECT mine_id, feature_date, feature_freshness_score AS score, previous_value,
  round(delta, 6) AS delta, round(abs(delta), 6) AS abs_delta,
  CASE WHEN delta > 0.1 THEN 'INCREASE' WHEN delta < -0.1 THEN 'DECREASE' ELSE 'STABLE' END AS direction FROM d
""")
def score_deltas(spark, sf):
    return _deltas(spark, sf).select(
        "mine_id", "feature_date", F.col("feature_freshness_score").alias("score"), "previous_value", "delta", "abs_delta", "direction"
    )


@query("e02_recent_changes", f"""
WITH recent AS (SELECT * FROM gold_features WHERE feature_date >= (SELECT max(feature_date) FROM gold_features) - INTERVAL 7 DAY),
d AS ({DELTAS.replace('gold_features', 'recent')})
SELECT mine_id, feature_date, feature_freshness_score AS score, round(delta, 6) AS delta,
  CASE WHEN delta > 0.01 THEN 'increase' WHEN delta < -0.01 THEN 'decrease' ELSE 'stable' END AS direction
FROM d ORDER BY feature_date DESC, mine_id LIMIT 50
""")
def recent_changes(spark, sf):
    """The lookback filter precedes the lag, so the first row in range drops out."""
    recent = st.gold_features(spark, sf, st.days_before_latest(spark, sf, 7))
    changes = win.deltas(recent, "mine_id", "feature_date", "feature_freshness_score", 0.01, ("increase", "decrease", "stable"))
    return changes.orderBy(F.col("feature_date").desc(), "mine_id").limit(50).select(
        "mine_id", "feature_date", F.col("feature_freshness_score").alias("score"), "delta", "direction"
    )


@query("e03_latest_row_per_key", """
SELECT mine_id, feature_date, production_mt, esg_score FROM (SELECT *, row_number() OVER (PARTITION BY mine_id ORDER BY feature_date DESC) rn
FROM gold_features) WHERE rn = 1
""")
def latest_row_per_key(spark, sf):
    gold = st.gold_features(spark, sf).select("mine_id", "feature_date", "production_mt", "esg_score")
    return rel.first_per_key(gold, ["mine_id"], [F.col("feature_date")])


@query("e03_latest_score_function", """
SELECT score_id, round(score, 6) AS score, created_at FROM composite_scores WHERE sub_industry = 'BUILDING' AND horizon = 10
ORDER BY created_at DESC, score_id DESC LIMIT 1
""")
def latest_score_function(spark, sf):
    chosen = rel.where_equal(st.composite_scores(spark, sf), sub_industry="BUILDING", country=None, horizon=10)
    return chosen.orderBy(F.col("created_at").desc(), F.col("score_id").desc()).limit(1).select("score_id", "score", "created_at")


@query("e04_rows_at_group_maximum", """
SELECT score_id, sub_industry, country, horizon, created_at FROM composite_scores cs
WHERE created_at = (SELECT max(created_at) FROM composite_scores c WHERE c.sub_industry = cs.sub_industry
  AND c.country = cs.country AND c.horizon = cs.horizon)
""")
def rows_at_group_maximum(spark, sf):
    scores = st.composite_scores(spark, sf).select("score_id", "sub_industry", "country", "horizon", "created_at")
    return win.at_group_maximum(scores, ["sub_industry", "country", "horizon"], "created_at")


@query("e05_forward_fill", """
SELECT event_id, user_id, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS filled FROM gappy
""")
def forward_fill(spark, sf):
    filled = win.forward_fill(st.gappy(spark, sf), ["user_id"], ["event_id"], "value", "filled")
    return filled.select("event_id", "user_id", "filled")


@query("e06_expanding_folds", """
WITH r AS (SELECT mine_id, feature_date, row_number() OVER (ORDER BY feature_date, mine_id) - 1 AS pos,
   count(*) OVER () AS n FROM gold_features),
f AS (SELECT r.*, fold, n - (5 - fold) * (n // 6) AS first_test FROM r, range(5) t(fold))
SELECT mine_id, feature_date, fold::BIGINT AS fold, CASE WHEN pos < first_test THEN 'train' ELSE 'test' END AS part
FROM f WHERE pos < first_test + n // 6
""")
def expanding_folds(spark, sf):
    gold = st.gold_features(spark, sf).select("mine_id", "feature_date")
    return win.expanding_folds(gold, ["feature_date", "mine_id"], 5)


@query("e07_label_codes", """
SELECT score_id, country, dense_rank() OVER (ORDER BY country NULLS FIRST) - 1 AS code FROM composite_scores
""")
def label_codes(spark, sf):
    return win.label_codes(st.composite_scores(spark, sf).select("score_id", "country"), "country", "code")


@query("e08_appearance_codes", """
WITH f AS (SELECT sub_industry, min(score_id) AS first_id FROM composite_scores GROUP BY 1),
c AS (SELECT sub_industry, row_number() OVER (ORDER BY first_id) - 1 AS code FROM f)
SELECT score_id, s.sub_industry, code FROM composite_scores s JOIN c ON s.sub_industry = c.sub_industry
""")
def appearance_codes(spark, sf):
    return win.appearance_codes(st.composite_scores(spark, sf).select("score_id", "sub_industry"), "sub_industry", "score_id", "code")


@query("e09_standardise", """
SELECT event_id, round((value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events), 6) AS z_value,
  0.0::DOUBLE AS z_one FROM events
""")
def standardise(spark, sf):
    frame = st.table(spark, sf, "events").select("event_id", "value", F.lit(1.0).alias("one"))
    return win.standardise(frame, ["value", "one"]).select("event_id", "z_value", "z_one")


@query("e10_sample_z_score", """
SELECT score_id, sub_industry, country, horizon, round(CASE WHEN count(score) OVER w <= 1 OR stddev_samp(score) OVER w = 0 THEN 0
  ELSE (score - avg(score) OVER w) / stddev_samp(score) OVER w END, 6) AS z
FROM composite_scores WINDOW w AS (PARTITION BY sub_industry, country, horizon)
""")
def sample_z_score(spark, sf):
    scores = st.composite_scores(spark, sf).select("score_id", "sub_industry", "country", "horizon", "score")
    return win.z_scores(scores, ["sub_industry", "country", "horizon"], "score", "z").drop("score")


@query("e11_percentile_rank", """
SELECT score_id, sub_industry, horizon, round(percent_rank() OVER (PARTITION BY sub_industry, horizon ORDER BY score) * 100, 6) AS percentile
FROM composite_scores
""")
def percentile_rank(spark, sf):
    scores = st.composite_scores(spark, sf).select("score_id", "sub_industry", "horizon", "score")
    return win.percent_rank(scores, ["sub_industry", "horizon"], "score", "percentile").drop("score")


@query("e12_top_contributions", """
WITH c AS (SELECT entity_id, metric, round(value - 50, 6) AS contribution FROM component_long)
SELECT entity_id, metric, round(contribution, 6) AS contribution, rank FROM (SELECT *, row_number()
  OVER (PARTITION BY entity_id ORDER BY abs(contribution) DESC, metric) AS rank FROM c) WHERE rank <= 3
""")
def top_contributions(spark, sf):
    contributions = {m: F.round(F.col(m) - 50, 6) for m in fixed.COMPONENT_WEIGHTS}
    return win.top_contributions(st.entity_components(spark, sf), "entity_id", contributions, 3).withColumnRenamed("feature", "metric")


@query("e13_last_activity", "SELECT conv_id, max(created_at) AS last_activity FROM messages GROUP BY conv_id")
def last_activity(spark, sf):
    return st.messages(spark, sf).groupBy("conv_id").agg(F.max("created_at").alias("last_activity"))


@query("e14_messages_in_order", """
SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY created_at, turn) AS ordinal FROM messages
""")
def messages_in_order(spark, sf):
    return conversations.ordered(st.messages(spark, sf).select("conv_id", "turn", "role", "text", "created_at")).drop("created_at")


@query("e15_entity_scores_newest_first", """
SELECT score_id, created_at, round(score, 6) AS score FROM composite_scores WHERE sub_industry = 'MACHINERY'
ORDER BY created_at DESC, score_id
""")
def entity_scores_newest_first(spark, sf):
    chosen = rel.where_equal(st.composite_scores(spark, sf), sub_industry="MACHINERY", country=None)
    return chosen.orderBy(F.col("created_at").desc(), "score_id").select("score_id", "created_at", "score")


@query("e16_session_with_messages", """
SELECT conv_id, turn // 1000 AS page, count(*) AS n_messages,
  string_agg(concat(role, ': ', text), chr(10) ORDER BY turn) AS transcript FROM messages GROUP BY 1, 2
""")
def session_with_messages(spark, sf):
    nested = conversations.nested(st.messages(spark, sf))
    line = F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["text"]))
    return nested.select("conv_id", "page", F.size("messages").alias("n_messages"), F.array_join(line, "\n").alias("transcript"))
