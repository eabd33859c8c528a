"""Sinks, read back so that what was written is what gets compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from seamline.functions import dates, numeric
from seamline.functions import text as tx
from seamline.operators import relational as rel
from seamline.plans import weights
from seamline.session import scratch
from seamline.sources import keyed_table, sinks
from seamline.workloads import standins as st
from seamline.workloads.joins import DIFF_SQL, _diff
from seamline.workloads.registry import query


@query("k01_replaced_table", "SELECT mine_id, feature_date, production_mt FROM gold_features")
def replaced_table(spark, sf):
    path = scratch(spark, "table")
    gold = st.gold_features(spark, sf).select("mine_id", "feature_date", "production_mt")
    gold.where("mine_id = 0").write.parquet(path)
    return sinks.replace_table(gold, path)


@query("k02_materialised_by_date", """
SELECT mine_id, feature_date, production_mt, (SELECT max(ts) FROM events) AS created_at FROM gold_features
WHERE feature_date BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-25'
""")
def materialised_by_date(spark, sf):
    path = scratch(spark, "features")
    as_of = rel.latest_value(st.table(spark, sf, "events"), "ts")
    for since, until in ((dates.stamp("2024-01-03"), dates.stamp("2024-01-20")), (dates.stamp("2024-01-10"), dates.stamp("2024-01-25"))):
        gold = st.gold_features(spark, sf, since, until).select("mine_id", "feature_date", "production_mt")
        part = gold.where(F.col("feature_date").between(since, until))
        sinks.materialise_by_date(part, path, "feature_date", as_of)
    return spark.read.parquet(path).drop("_day")


@query("k03_appended_changes", f"SELECT name, country, status FROM ({DIFF_SQL}) WHERE status IN ('new', 'updated')")
def appended_changes(spark, sf):
    path = scratch(spark, "changes")
    changes = _diff(spark, sf).select("name", "country", "status")
    for status in ("new", "updated"):
        sinks.append_json(changes.where(F.col("status") == status), path)
    return spark.read.schema("name string, country string, status string").json(path)


@query("k04_exported_rows", """
SELECT concat('{"definition_id":', definition_id, ',"country":"', country, '","year":', year, ',"quarter":', quarter, '}') AS json_line,
  concat(definition_id, ',', country, ',', year, ',', quarter) AS csv_line
FROM metric_values WHERE sub_industry = 'HOUSEHOLD' AND year = 1998
""")
def exported_rows(spark, sf):
    """Filter first, then render: no row is lost to a limit."""
    rows = rel.where_equal(st.metric_values(spark, sf), sub_industry="HOUSEHOLD", year=1998, country=None)
    cols = F.struct("definition_id", "country", "year", "quarter")
    return rows.select(F.to_json(cols).alias("json_line"), F.to_csv(cols).alias("csv_line"))


@query("k05_upserted_rows", """
SELECT doc_id, CASE WHEN lang = 'en' THEN 'updated' ELSE source END AS source, CASE WHEN lang = 'en' THEN 2 ELSE 1 END::BIGINT AS version FROM documents
UNION ALL SELECT -doc_id - 1, 'added', 2 FROM documents WHERE lang = 'de'
""")
def upserted_rows(spark, sf):
    docs = st.table(spark, sf, "documents")
    stored = docs.select("doc_id", "source", F.lit(1).cast("bigint").alias("version"))
    updated = docs.where("lang = 'en'").select("doc_id", F.lit("updated").alias("source"), F.lit(2).cast("bigint").alias("version"))
    added = docs.where("lang = 'de'").select(
        (-F.col("doc_id") - 1).alias("doc_id"), F.lit("added").alias("source"), F.lit(2).cast("bigint").alias("version")
    )
    table = keyed_table.create(stored, scratch(spark, "documents"), ["doc_id"], ["version"])
    return table.upsert(updated.unionByName(added), ["version"]).read()


@query("k06_inserted_if_new", """
SELECT c_custkey AS id, c_name AS name FROM customer
UNION ALL SELECT -o_custkey - 1, 'new' FROM (SELECT DISTINCT o_custkey FROM orders)
""")
def inserted_if_new(spark, sf):
    stored = st.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    buyers = st.table(spark, sf, "orders").select("o_custkey").distinct()
    known = buyers.select(F.col("o_custkey").alias("id"), F.lit("kept as stored").alias("name"))
    new = buyers.select((-F.col("o_custkey") - 1).alias("id"), F.lit("new").alias("name"))
    return sinks.insert_new(stored, known.unionByName(new), ["id"])


@query("k07_rotated_weights", """
WITH g AS (SELECT metric AS metric_slug, round(avg(value) / 100, 6) AS weight_value FROM component_long GROUP BY 1)
SELECT metric_slug, weight_value, false AS is_active, TIMESTAMP '2024-01-01' AS created_at, TIMESTAMP '2024-01-30' AS updated_at FROM active_weights
UNION ALL SELECT metric_slug, weight_value, true, TIMESTAMP '2024-01-30', TIMESTAMP '2024-01-30' FROM g
""")
def rotated_weights(spark, sf):
    opened = dates.stamp("2024-01-01")
    table = st.active_weights(spark).select(
        "metric_slug", "weight_value", F.lit(True).alias("is_active"), opened.alias("created_at"), opened.alias("updated_at")
    )
    fresh = st.component_long(spark, sf).groupBy(F.col("metric").alias("metric_slug")).agg((F.avg("value") / 100).alias("weight_value"))
    return weights.rotate(table, fresh, dates.stamp("2024-01-30"))


def _registry(spark, sf):
    return st.composite_scores(spark, sf).select(
        F.col("sub_industry").alias("model_type"), F.col("score_id").cast("string").alias("model_version"),
        F.col("score").alias("rmse"), "created_at", (F.col("horizon") == 5).alias("is_active"),
    )


@query("k08_activated_version", """
WITH pick AS (SELECT min(score_id) AS id FROM composite_scores WHERE sub_industry = 'BUILDING')
SELECT sub_industry AS model_type, CAST(score_id AS VARCHAR) AS model_version,
  CASE WHEN sub_industry = 'BUILDING' THEN score_id = (SELECT id FROM pick) ELSE horizon = 5 END AS is_active FROM composite_scores
""")
def activated_version(spark, sf):
    registry = _registry(spark, sf)
    building = st.composite_scores(spark, sf).where("sub_industry = 'BUILDING'")
    version = str(building.agg(F.min("score_id")).first()[0])
    return sinks.activate_version(registry, "BUILDING", version).select("model_type", "model_version", "is_active")


@query("k09_updated_and_deleted", """
SELECT s_suppkey AS source_id, s_name AS name, CASE WHEN s_acctbal < 0 THEN 0.0 ELSE s_acctbal END AS balance
FROM supplier WHERE s_nationkey <> 3
""")
def updated_and_deleted(spark, sf):
    sites = st.table(spark, sf, "supplier")
    table = sites.select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    changes = sites.where("s_acctbal < 0").select(
        F.col("s_suppkey").alias("source_id"), F.lit(None).cast("string").alias("name"), F.lit(0.0).alias("balance")
    )
    gone = sites.where("s_nationkey = 3").select(F.col("s_suppkey").alias("source_id"))
    stored = keyed_table.create(table, scratch(spark, "sources"), ["source_id"], ["name"])
    return stored.update(changes, ["balance"]).delete(gone).read()


N12_SQL = """(coalesce(structured_availability, 0) + coalesce(country_level_availability, 0) + coalesce(sub_industry_availability, 0)
  + coalesce(volume_of_data, 0) + coalesce(alternative_proxy_feasibility, 0) + coalesce(genai_ml_fillability, 0)
  + coalesce(longitudinal_availability, 0) + 6 - coalesce(nullif(data_verification_bias_risk, 0), 3)
  + 6 - coalesce(nullif(interdependence_with_other_metrics, 0), 3)) / 9.0"""


def application_confidence():
    return numeric.confidence_application(*[F.col(c) for c in (
        "structured_availability", "country_level_availability", "sub_industry_availability", "volume_of_data",
        "alternative_proxy_feasibility", "genai_ml_fillability", "longitudinal_availability",
        "data_verification_bias_risk", "interdependence_with_other_metrics")])


@query("k10_appended_with_confidence", f"""
SELECT definition_id, round({N12_SQL}, 6) AS confidence FROM metric_definitions
""")
def appended_with_confidence(spark, sf):
    path = scratch(spark, "definitions")
    rows = st.metric_definitions(spark, sf).withColumn("confidence", application_confidence())
    for status in (F.col("readiness_status").isNull(), F.col("readiness_status").isNotNull()):
        rows.where(status).select("definition_id", "confidence").write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query("k11_merged_context", """
SELECT conv_id, max(CASE WHEN role = 'user' THEN turn END)::VARCHAR AS last_turn, 'user' AS role,
  CAST(count(*) AS VARCHAR) AS n FROM messages GROUP BY conv_id HAVING count(*) FILTER (role = 'user') > 0
""")
def merged_context(spark, sf):
    msgs = st.messages(spark, sf)
    sessions = msgs.groupBy("conv_id").agg(
        F.create_map(F.lit("role"), F.lit("none"), F.lit("n"), F.count("*").cast("string")).alias("context"))
    updates = msgs.where("role = 'user'").groupBy("conv_id").agg(
        F.create_map(F.lit("role"), F.lit("user"), F.lit("last_turn"), F.max("turn").cast("string")).alias("context"))
    merged = sinks.merge_context(sessions, updates, "conv_id", "context")
    return merged.where("context['role'] = 'user'").select(
        "conv_id", *[F.col("context").getItem(k).alias(k) for k in ("last_turn", "role", "n")]
    )


@query("k12_stored_values", """
WITH v AS (SELECT s_name AS title, s_acctbal AS value FROM supplier UNION ALL SELECT p_name, p_retailprice FROM part)
SELECT title, round(value, 6) AS value, sha256(title) AS definition_id FROM v
""")
def stored_values(spark, sf):
    c = F.col
    known = st.table(spark, sf, "supplier").select(c("s_name").alias("title"), F.sha2("s_name", 256).alias("definition_id"))
    values = st.table(spark, sf, "supplier").select(c("s_name").alias("title"), c("s_acctbal").alias("value")).unionByName(
        st.table(spark, sf, "part").select(c("p_name").alias("title"), c("p_retailprice").alias("value")))
    return sinks.store_values(known, values, "title")[1]
