"""Scans and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from seamline import fixed
from seamline.functions import dates
from seamline.functions import text as tx
from seamline.session import scratch
from seamline.sources import feeds, tables
from seamline.workloads import standins as st
from seamline.workloads.registry import query

ENVELOPE_SQL = """SELECT source, dataset, indicator, series_id, commodity_code, country, year, data,
  TIMESTAMP '2024-01-31 06:00:00' AS extracted_at, sha256(data)[1:16] AS provenance_hash, 1::BIGINT AS trust_rank FROM feed_payloads"""


@query("a01_landed_envelopes", ENVELOPE_SQL)
def landed_envelopes(spark, sf):
    path = scratch(spark, "feeds")
    feeds.land(st.feed_payloads(spark, sf).withColumn("extracted_at", dates.stamp("2024-01-31 06:00:00")), path)
    return feeds.read_landed(spark, path).drop("_corrupt_record")


FLAT_SQL = """WITH p AS (SELECT country, y, CAST(sum(n) AS BIGINT) AS n, CAST(sum(amount) AS BIGINT) AS amount FROM feed_points GROUP BY 1, 2),
s AS (SELECT series, y, CAST(sum(n) AS BIGINT) AS n FROM feed_points GROUP BY 1, 2),
flat AS (
SELECT 'IEA' AS source, country AS key, CAST(y AS VARCHAR) AS period, CAST(n AS DOUBLE) AS value, 'orders' AS unit, NULL::VARCHAR AS error FROM p WHERE country <> 'NATION_3'
UNION ALL SELECT DISTINCT 'IEA', NULL, NULL, NULL::DOUBLE, NULL, 'No data in response' FROM p WHERE country = 'NATION_3'
UNION ALL SELECT 'EIA', series, CAST(y AS VARCHAR), n, 'orders', NULL FROM s
UNION ALL SELECT 'WorldBank', country, CAST(y AS VARCHAR), amount, 'USD', NULL FROM p WHERE country <> 'NATION_5'
UNION ALL SELECT DISTINCT 'WorldBank', NULL, NULL, NULL::DOUBLE, NULL, 'Invalid data format' FROM p WHERE country = 'NATION_5'
UNION ALL SELECT 'UNComtrade', country, CAST(y AS VARCHAR), amount, 'X', NULL FROM p
UNION ALL SELECT 'IMF', country, CAST(y AS VARCHAR), n, 'ENDA', NULL FROM p)
"""


@query("a02_flattened_payloads", FLAT_SQL + "SELECT * FROM flat WHERE source IN ('IEA', 'EIA', 'WorldBank')")
def flattened_payloads(spark, sf):
    return feeds.routed(_landed(spark, sf).where(F.col("source").isin("IEA", "EIA", "WorldBank")))


def _landed(spark, sf):
    """The responses, landed once and read back."""
    path = scratch(spark, "responses")
    feeds.land(st.feed_payloads(spark, sf), path)
    return feeds.read_landed(spark, path)


@query("a03_nested_map_payload", FLAT_SQL + """SELECT source, unit AS indicator, key AS country, CAST(period AS BIGINT) AS year, value
FROM flat WHERE source = 'IMF'""")
def nested_map_payload(spark, sf):
    return feeds.indicator_points(st.feed_payloads(spark, sf))


@query("a04_merged_sources", FLAT_SQL + """SELECT source, count(*) FILTER (error IS NULL) AS records,
  count(error) AS failures FROM flat GROUP BY source""")
def merged_sources(spark, sf):
    merged = feeds.merged_records(_landed(spark, sf))
    return merged.groupBy("source").agg(F.count_if(F.col("error").isNull()).alias("records"), F.count("error").alias("failures"))


@query("a04_quarantined_responses", """
WITH broken AS (SELECT source, country, year, CASE WHEN length(data) % 3 = 0 THEN data[1:length(data) - 2] WHEN length(data) % 7 = 0 THEN NULL ELSE data END AS data FROM feed_payloads)
SELECT source, country, year, data, CASE WHEN data IS NULL THEN 'no text' ELSE 'not JSON' END AS reason FROM broken WHERE data IS NULL OR NOT json_valid(data)
""")
def quarantined_responses(spark, sf):
    """Responses of which some arrive cut off or without a text."""
    size = F.length("data")
    broken = F.when(size % 3 == 0, F.substring(F.col("data"), F.lit(1), size - 2)).when(size % 7 == 0, F.lit(None).cast("string")).otherwise(F.col("data"))
    return feeds.quarantined(st.feed_payloads(spark, sf).select("source", "country", "year", broken.alias("data")))


def _values(items):
    return ", ".join(f"('{i}')" for i in items)


@query("a05_request_plan", f"""
SELECT 'IEA' AS source, i AS item, n_name AS country, NULL::BIGINT AS year FROM nation, (VALUES {_values(fixed.IEA_DATASETS)}) t(i)
UNION ALL SELECT 'WorldBank', i, n_name, NULL FROM nation, (VALUES {_values(fixed.WORLD_BANK_INDICATORS)}) t(i)
UNION ALL SELECT 'IMF', i, n_name, NULL FROM nation, (VALUES {_values(fixed.IMF_INDICATORS)}) t(i)
UNION ALL SELECT 'UNComtrade', i, NULL, y FROM (SELECT DISTINCT CAST(year(o_orderdate) AS BIGINT) AS y FROM orders), (VALUES {_values(fixed.TRADE_CODES)}) t(i)
""")
def request_plan(spark, sf):
    countries = st.nations(spark, sf).select(F.col("n_name").alias("country"))
    years = st.table(spark, sf, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    return feeds.request_plan(countries, years)


@query("a06_split_scan", """
WITH b AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders)
SELECT least((o_orderkey - lo) * 8 // greatest(hi - lo, 1), 7) AS stride, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders, b GROUP BY 1
""", digits=2)
def split_scan(spark, sf):
    """Parquet stands in for the database: rows per stride of the partition column."""
    return tables.by_stride(st.table(spark, sf, "orders"), "o_orderkey", 8).groupBy("stride").agg(
        F.count("*").alias("n"), F.sum("o_totalprice").alias("total")
    )


@query("a07_scan_by_name", "SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part")
def scan_by_name(spark, sf):
    st.table(spark, sf, "part").createOrReplaceTempView("seamline_part")
    return tables.named_scan(spark, "seamline_part")


SHEET_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.SHEET_NUMBERS.items())


@query("a08_nested_catalogue", f"""
WITH k AS (SELECT *, concat(CASE sheet_name {SHEET_SQL} ELSE '00' END) AS num,
  regexp_replace(replace(replace(lower(title), ' ', '_'), '-', '_'), '[^a-z_]', '', 'g') AS slug FROM metric_definitions)
SELECT definition_id, concat(num, '_', slug) AS metric_key, concat('f_', num, '_', slug) AS feature_column, sheet_name,
  num AS sheet_number, title, weighting AS weighting_in_metric, structured_availability, readiness_status,
  concat('w_', num, '_', slug, '_H10') AS weight_h10 FROM k
""")
def nested_catalogue(spark, sf):
    d = st.metric_definitions(spark, sf)
    key = tx.metric_key(F.col("sheet_name"), F.col("title"))
    entry = F.struct(
        key.alias("metric_key"), tx.feature_name(key).alias("feature_column"),
        F.struct("sheet_name", tx.sheet_number(F.col("sheet_name")).alias("sheet_number")).alias("sheet_info"),
        F.struct("title", F.col("weighting").alias("weighting_in_metric")).alias("basic_info"),
        F.struct("structured_availability", "volume_of_data").alias("data_quality"),
        F.struct("readiness_status").alias("assessment"),
        F.struct(*[tx.weight_name(key, F.lit(h)).alias(h) for h in fixed.HORIZONS]).alias("weight_columns"),
    )
    return tables.catalogue_definitions(d.select("definition_id", F.to_json(entry).alias("json")), "json")


@query("a09_source_sheet", """
SELECT s_name AS name, CASE WHEN s_nationkey % 3 = 0 THEN NULL ELSE CAST(s_nationkey AS BIGINT) END AS update_lag_days,
  CASE s_nationkey % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false END AS api_available, n_name AS country
FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal >= 0
""")
def source_sheet(spark, sf):
    path = scratch(spark, "sheet")
    nation = F.col("s_nationkey")
    st._sites(spark, sf).select(
        F.when(F.col("s_acctbal") >= 0, F.col("s_name")).alias("Name"),
        F.when(nation % 3 == 0, "monthly").otherwise(nation.cast("string")).alias("Update Lag_days"),
        F.when(nation % 4 == 0, "Yes").when(nation % 4 == 1, "1").when(nation % 4 == 2, "no").alias("API"),
        F.col("n_name").alias("Country"),
    ).write.option("header", True).csv(path)
    return tables.source_sheet(tables.read_sheet(spark, path))


@query("a09_metric_sheet", """
SELECT concat(p_name, ' ', p_type) AS title, CASE WHEN p_size % 2 = 0 THEN NULL ELSE CAST(p_size AS BIGINT) END AS structured_availability,
  p_retailprice AS weighting_in_metric, lower(replace(concat(p_name, ' ', p_type), ' ', '_')) AS metric_slug FROM part WHERE p_size <> 13
""")
def metric_sheet(spark, sf):
    path = scratch(spark, "sheet")
    size = F.col("p_size")
    st.table(spark, sf, "part").select(
        F.when(size != 13, F.concat_ws(" ", "p_name", "p_type")).alias("Title"),
        F.when(size % 2 == 0, F.concat(size.cast("string"), F.lit(".7"))).otherwise(size.cast("string")).alias("Structured"),
        F.col("p_retailprice").cast("string").alias("Weighting In Metric"),
        F.lit(None).cast("string").alias("METRIC"),
    ).write.option("header", True).csv(path)
    return tables.metric_sheet(tables.read_sheet(spark, path))


@query("a10_all_sheets", """
SELECT sheet_name, concat(p_name, ' ', p_type) AS title, lower(replace(concat(p_name, ' ', p_type), ' ', '_')) AS metric_slug,
  CAST(p_size AS BIGINT) AS structured_availability FROM (SELECT *, p_brand AS sheet_name FROM part)
""")
def all_sheets(spark, sf):
    """One folder per sheet; the folder name comes back as the sheet column."""
    path = scratch(spark, "sheets")
    st.table(spark, sf, "part").select(
        F.col("p_brand").alias("sheet_name"), F.concat_ws(" ", "p_name", "p_type").alias("Title"),
        F.col("p_size").cast("string").alias("Structured"),
    ).write.partitionBy("sheet_name").option("header", True).csv(path)
    return tables.metric_sheet(tables.read_sheet(spark, path))


@query("a11_sheet_body", """
SELECT p_partkey, CASE WHEN p_size > 3 THEN p_name END AS metric, CASE WHEN p_size > 2 THEN p_type END AS title
FROM part WHERE p_size > 2 AND p_size <> 10
""")
def sheet_body(spark, sf):
    size = F.col("p_size")
    sheet = st.table(spark, sf, "part").select(
        "p_partkey",
        F.when(size == 10, "Metric").when(size > 3, F.col("p_name")).alias("metric"),
        F.when(size > 2, F.col("p_type")).alias("title"),
    )
    return tables.body_rows(sheet, "metric", "title")


@query("a12_document_files", """
SELECT source, CASE WHEN trim(text) <> '' THEN 'processed' ELSE 'failed' END AS status, count(*) AS n FROM documents GROUP BY 1, 2
""")
def document_files(spark, sf):
    path = scratch(spark, "documents")
    st.table(spark, sf, "documents").select("doc_id", "text", "source", "lang").write.partitionBy("lang").json(path)
    found = tables.document_files(spark, path, "*.json")
    return found.groupBy("source", "status").agg(F.count("*").alias("n"))


FIELD_PATTERNS = {
    "name": [r"<h2[^>]*>([^<]*)</h2>", r"<h1[^>]*>([^<]*)</h1>", r"<title>([^<]*)</title>"],
    "country": [r'<html lang="([a-z]+)"', r'data-country="([^"]*)"'],
    "link": [r'<a href="([^"]*)"'],
}


@query("a13_crawled_fields", """
SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '<h2[^>]*>([^<]*)</h2>', 1)), ''),
    nullif(trim(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1)), ''), nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '')) AS name,
  coalesce(nullif(trim(regexp_extract(html, '<html lang="([a-z]+)"', 1)), ''), nullif(trim(regexp_extract(html, 'data-country="([^"]*)"', 1)), '')) AS country,
  nullif(trim(regexp_extract(html, '<a href="([^"]*)"', 1)), '') AS link FROM pages
""")
def crawled_fields(spark, sf):
    return tables.crawled_fields(st.table(spark, sf, "pages"), "html", FIELD_PATTERNS).select("page_id", *FIELD_PATTERNS)


@query("a14_payload_items", """
SELECT n_name AS country, s_suppkey // 100 AS page, s_name AS name, s_suppkey AS site
FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name <> 'NATION_6'
""")
def payload_items(spark, sf):
    return tables.payload_items(st.site_payloads(spark, sf), "payload", "name:string,site:bigint")


@query("a15_special_columns", """
SELECT '4 Emissions Score' AS sheet_name, 'Employees' AS column_name, definition_id AS row_key, CAST(volume_of_data AS VARCHAR) AS value
FROM metric_definitions WHERE sheet_name = '4 Emissions Score'
UNION ALL SELECT '4 Emissions Score', 'Value_Added_USD', definition_id, CAST(definition_id * 10 AS VARCHAR) FROM metric_definitions WHERE sheet_name = '4 Emissions Score'
UNION ALL SELECT '20 Economic Score', 'Variable Data Fields', definition_id, raw_slug FROM metric_definitions WHERE sheet_name = '20 Economic Score'
""")
def special_columns(spark, sf):
    sheet = st.metric_definitions(spark, sf).select(
        "definition_id", "sheet_name", F.col("volume_of_data").alias("Employees"),
        (F.col("definition_id") * 10).alias("Value_Added_USD"), F.col("raw_slug").alias("Variable Data Fields"),
    )
    return tables.special_columns(sheet, "definition_id", "sheet_name")


@query("a16_nested_source_records", """
SELECT trim(s_name) AS name, 'External' AS source_type, CASE s_nationkey % 4 WHEN 0 THEN true WHEN 1 THEN true ELSE false END AS api_available,
  true AS is_active, concat('{"country":"', n_name, '"}') AS metadata FROM supplier JOIN nation ON s_nationkey = n_nationkey
""")
def nested_source_records(spark, sf):
    frame = st.data_sources(spark, sf).withColumns({"kind": F.lit(" "), "sector": F.lit(None).cast("string")})
    nested = tables.source_records(frame, "name", "kind", "api_available", ["country", "sector"])
    return nested.withColumn("metadata", F.to_json("metadata"))
