"""Sorts, limits, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from seamline import fixed
from seamline.functions import text as tx
from seamline.operators import relational as rel
from seamline.operators import windows as win
from seamline.plans import weights
from seamline.workloads import standins as st
from seamline.workloads.registry import query


@query("l01_sorted_features", "SELECT mine_id, feature_date, production_mt FROM gold_features ORDER BY mine_id, feature_date")
def sorted_features(spark, sf):
    return st.gold_features(spark, sf).select("mine_id", "feature_date", "production_mt").orderBy("mine_id", "feature_date")


@query("l02_page", "SELECT definition_id, title FROM metric_definitions ORDER BY definition_id OFFSET 40 LIMIT 20")
def page(spark, sf):
    return rel.page(st.metric_definitions(spark, sf).select("definition_id", "title"), ["definition_id"], 40, 20)


@query("l03_top_and_bottom_movers", """
WITH g AS (SELECT metric, round(avg(value) / 100, 9) AS gain FROM component_long GROUP BY metric),
c AS (SELECT metric, coalesce(w.weight_value, 0.5) AS old_weight, gain, round(gain - coalesce(w.weight_value, 0.5), 9) AS change
  FROM g LEFT JOIN active_weights w ON w.metric_slug = g.metric),
p AS (SELECT *, CASE WHEN old_weight > 0 THEN change / old_weight * 100 ELSE 0 END AS change_pct FROM c)
(SELECT 'increase' AS side, metric, old_weight, round(gain, 6) AS gain, round(change, 6) AS change, round(change_pct, 6) AS change_pct FROM p ORDER BY p.change DESC, metric LIMIT 5)
UNION ALL (SELECT 'decrease', metric, old_weight, round(gain, 6), round(change, 6), round(change_pct, 6) FROM p ORDER BY p.change, metric LIMIT 5)
""")
def top_and_bottom_movers(spark, sf):
    gains = st.component_long(spark, sf).groupBy("metric").agg(F.round(F.avg("value") / 100, 9).alias("gain"))
    return weights.movers(weights.changes(gains, st.active_weights(spark)), 5)


@query("l04_top_importances", """
SELECT metric, round(stddev_pop(value), 6) AS importance FROM component_long GROUP BY metric ORDER BY stddev_pop(value) DESC, metric LIMIT 5
""")
def top_importances(spark, sf):
    spread = st.component_long(spark, sf).groupBy("metric").agg(F.stddev_pop("value").alias("importance"))
    return spread.orderBy(F.col("importance").desc(), "metric").limit(5)


@query("l05_last_rows_ascending", """
SELECT * FROM (SELECT event_id, ts, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 10) ORDER BY ts, event_id
""")
def last_rows_ascending(spark, sf):
    events = st.table(spark, sf, "events").select("event_id", "ts", "value")
    return win.last_rows(events, [F.col("ts").desc(), F.col("event_id").desc()], [F.col("ts"), F.col("event_id")], 10)


@query("l06_split_at_date_quantile", """
SELECT event_id, CASE WHEN epoch_us(ts) <= (SELECT quantile_cont(epoch_us(ts)::DOUBLE, 0.8) FROM events) THEN 'train' ELSE 'test' END AS part FROM events
""")
def split_at_date_quantile(spark, sf):
    return win.split_at_quantile(st.table(spark, sf, "events").select("event_id", "ts"), "ts", 0.8).drop("ts")


@query("l07_heaviest_metrics", """
SELECT metric, round(avg(value) / 100, 6) AS weight FROM component_long GROUP BY metric ORDER BY avg(value) DESC, metric LIMIT 10
""")
def heaviest_metrics(spark, sf):
    means = st.component_long(spark, sf).groupBy("metric").agg((F.avg("value") / 100).alias("weight"))
    return means.orderBy(F.col("weight").desc(), "metric").limit(10)


@query("s01_union_of_sources", """
SELECT 'supplier' AS source, s_suppkey AS id, s_name AS name, s_acctbal AS balance, CAST(NULL AS VARCHAR) AS segment FROM supplier
UNION ALL BY NAME SELECT 'customer' AS source, c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL BY NAME SELECT 'part' AS source, p_partkey AS id, p_name AS name, CAST(NULL AS DOUBLE) AS balance, CAST(NULL AS VARCHAR) AS segment FROM part
""")
def union_of_sources(spark, sf):
    c = F.col
    return rel.union_tagged({
        "supplier": st.table(spark, sf, "supplier").select(c("s_suppkey").alias("id"), c("s_name").alias("name"), c("s_acctbal").alias("balance")),
        "customer": st.table(spark, sf, "customer").select(
            c("c_custkey").alias("id"), c("c_name").alias("name"), c("c_acctbal").alias("balance"), c("c_mktsegment").alias("segment")),
        "part": st.table(spark, sf, "part").select(c("p_partkey").alias("id"), c("p_name").alias("name")),
    })


@query("s02_duplicate_rows", "SELECT DISTINCT l_orderkey, l_returnflag, l_linestatus FROM lineitem")
def duplicate_rows(spark, sf):
    return st.table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus").dropDuplicates()


@query("s03_distinct_entities", """
SELECT DISTINCT g.mine_id, g.feature_date, e.country_code FROM gold_features g JOIN entity_country e ON g.mine_id = e.mine_id
""")
def distinct_entities(spark, sf):
    keys = st.table(spark, sf, "events").select(F.col("user_id").alias("mine_id"), F.date_trunc("day", "ts").alias("feature_date")).distinct()
    return keys.join(st.entity_country(spark, sf), "mine_id").select("mine_id", "feature_date", "country_code")


@query("s04_key_difference", """
SELECT name, country FROM crawl_current EXCEPT SELECT name, country FROM crawl_previous
""")
def key_difference(spark, sf):
    return rel.key_difference(
        st.crawl_current(spark, sf).select("name", "country"), st.crawl_previous(spark, sf), ["name", "country"]
    )


@query("s05_missing_formula_inputs", """
WITH names AS (SELECT definition_id, regexp_extract_all(title, '[a-z]+') AS present FROM metric_definitions)
SELECT definition_id, array_to_string(list_sort(list_filter(['blue', 'red', 'ring', 'widget'], lambda x: NOT list_contains(present, x))), ',') AS missing
FROM names
""")
def missing_formula_inputs(spark, sf):
    """Required variables a definition does not name."""
    required = F.array_sort(tx.formula_variables(F.lit("(red + blue) / max(ring, widget)")))
    present = F.regexp_extract_all("title", F.lit("([a-z]+)"), F.lit(1))
    return st.metric_definitions(spark, sf).select(
        "definition_id", F.array_join(F.array_except(required, present), ",").alias("missing")
    )
