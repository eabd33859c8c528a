"""SQL text of the stand-in views; ``standins`` holds the DataFrame form."""

# Input columns of the formula catalogue as expressions over lineitem, valid in
# both engines.
FORMULA_INPUTS = {
    "E_primary_coal_share": "l_quantity",
    "Coal_baseload_share": "l_quantity",
    "Total_baseload_capacity": "l_extendedprice",
    "Coal_GDP_contribution": "l_tax",
    "Total_energy_GDP": "l_discount",
    "RPR_ratio_normalised": "l_discount",
    "Accessible_reserves": "l_quantity",
    "Total_reserves": "l_quantity + l_linenumber",
    "Current_grade": "l_tax",
    "Historical_average_grade": "l_tax + l_discount",
    "Direct_Subsidies_GDPpct": "l_discount",
    "Tax_Expenditure_GDPpct": "l_tax",
    "Policy_support_score": "CAST(l_linenumber AS DOUBLE)",
    "Max_policy_score": "CAST(7 AS DOUBLE)",
    "Artificial_price_support": "l_extendedprice * l_discount",
    "Market_price": "l_extendedprice",
    "CO2_t_per_MWh": "l_quantity",
    "CH4_emissions_factor": "l_tax",
    "Carbon_price_USD_per_t": "l_quantity",
    "Emissions_intensity": "l_discount",
    "Biodiversity_risk": "l_discount",
    "Water_stress_factor": "l_tax",
    "PM25_emissions_factor": "l_extendedprice",
    "Ecosystem_impact_score": "CAST(l_linenumber AS DOUBLE)",
    "Reskill_USD_per_worker": "l_extendedprice",
    "GDP_pc": "l_quantity * 1000",
    "Coal_jobs_per_GWh": "l_quantity",
    "Industry_avg_jobs_per_GWh": "CAST(l_linenumber AS DOUBLE)",
    "Transition_cost_total": "l_extendedprice",
    "Regional_GDP": "l_extendedprice * (1 + l_tax)",
    "Years_remaining": "CAST(l_linenumber AS DOUBLE)",
    "Nominal_life": "CAST(40 AS DOUBLE)",
    "Repurposing_score": "l_discount",
    "Max_repurposing_score": "l_tax",
    "Current_age": "CAST(l_linenumber AS DOUBLE)",
    "Design_life": "l_quantity",
    "HHI": "l_extendedprice / 10",
    "Top4_market_share": "l_quantity",
    "Price_markup": "l_tax",
    "Competitive_benchmark": "l_discount",
    "EBIT_margin": "l_discount - l_tax",
    "Price_volatility": "l_extendedprice / 1000",
    "CAPEX_per_MW": "l_extendedprice",
    "OPEX_per_MWh": "l_quantity",
    "LCOE_coal": "l_quantity",
    "LCOE_alternatives": "CAST(l_linenumber AS DOUBLE)",
    "Patent_growth_rate": "l_tax",
    "Performance_gap": "l_discount",
    "Historical_gap": "l_tax",
}

# The ten component scores (0-100) of an order, from its line items.
COMPONENTS = {
    "necessity_score": "avg(l_quantity) * 2",
    "resource_scarcity_score": "least(100, avg(l_extendedprice) / 1049)",
    "artificial_support_score": "avg(l_discount) * 1000",
    "emissions_score": "avg(l_tax) * 1250",
    "ecological_score": "avg(l_linenumber) * 14",
    "workforce_transition_score": "100 - avg(l_quantity) * 1.7",
    "infrastructure_repurposing_score": "100 - avg(l_discount) * 900",
    "monopoly_control_score": "greatest(0, 100 - avg(l_extendedprice) / 947)",
    "economic_score": "avg(abs(l_quantity - 25)) * 4",
    "technological_disruption_score": "avg(abs(l_linenumber - 4)) * 30",
}

# Availability grades of a metric definition, 0 standing for unknown.
GRADES = {
    "structured_availability": "nullif(p_size % 6, 0)",
    "unstructured_availability": "nullif((p_size + 1) % 6, 0)",
    "country_level_availability": "nullif((p_size + 2) % 6, 0)",
    "sub_industry_availability": "nullif((p_size + 3) % 6, 0)",
    "volume_of_data": "nullif((p_size + 4) % 6, 0)",
    "alternative_proxy_feasibility": "nullif((p_size + 5) % 6, 0)",
    "genai_ml_fillability": "nullif((p_size * 5) % 6, 0)",
    "longitudinal_availability": "nullif((p_size * 7) % 6, 0)",
    "data_verification_bias_risk": "nullif((p_size + 2) % 6, 0)",
    "interdependence_with_other_metrics": "nullif((p_size + 4) % 6, 0)",
}

_SHEET_CASE = """CASE p_size % 12
    WHEN 0 THEN '1 Necessity Score (Core)'
    WHEN 1 THEN '2 Resource Extraction & Scarcity Score'
    WHEN 2 THEN '3 Artificial Support Score'
    WHEN 3 THEN '4 Emissions Score'
    WHEN 4 THEN '5 Ecological Score'
    WHEN 5 THEN '8 Workforce Transition Score'
    WHEN 6 THEN '9 Infrastructure Repurposing Score'
    WHEN 7 THEN '11 Monopoly & Corporate Control Score'
    WHEN 8 THEN '20 Economic Score'
    WHEN 9 THEN '24. Technological Disruption Score'
    WHEN 10 THEN 'Data Sources'
    ELSE 'Unlisted Sheet' END"""

METRIC_DEFINITIONS = f"""SELECT p_partkey AS definition_id, {_SHEET_CASE} AS sheet_name,
    concat(p_name, ' ', p_type) AS title,
    concat(p_name, '-', p_type, ' ', p_brand) AS raw_slug,
    CASE WHEN p_size % 3 = 0 THEN 'Complete' WHEN p_size % 3 = 1 THEN 'Draft' END AS readiness_status,
    p_partkey % 10 AS source_id,
    {", ".join(f"CAST({e} AS BIGINT) AS {n}" for n, e in GRADES.items())},
    p_retailprice AS weighting
FROM part"""

VIEWS = {
    "gold_features": """SELECT user_id AS mine_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS feature_date,
    count(*) AS n_events,
    round(sum(value), 4) AS production_mt,
    round(max(value) * count(*), 4) AS capacity_mt,
    CAST(count(DISTINCT event_type) AS DOUBLE) / 5 AS feature_freshness_score,
    round(avg(CASE WHEN event_type = 'error' THEN value END), 6) AS esg_score,
    round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END), 4) AS revenue,
    round(sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END), 4) AS operating_cost,
    round(sum(CASE WHEN event_type = 'view' THEN value ELSE 0 END), 4) AS carbon,
    sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS incidents,
    round(max(value), 4) AS reserves
FROM events GROUP BY 1, 2""",
    "entity_country": """SELECT c_custkey AS mine_id, n_name AS country_code
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "metric_definitions": METRIC_DEFINITIONS,
    "metric_values": """SELECT l_partkey AS definition_id, c_mktsegment AS sub_industry, n_name AS country,
    CAST(year(o_orderdate) AS BIGINT) AS year, CAST(quarter(o_orderdate) AS BIGINT) AS quarter,
    l_extendedprice AS raw_value, l_discount AS normalized_value, l_suppkey AS source_id
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "data_sources": """SELECT s_suppkey AS source_id, s_name AS name, n_name AS country,
    CASE s_nationkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN '1' WHEN 2 THEN 'no' END AS api_available,
    s_acctbal AS balance
FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "composite_scores": """SELECT o_orderkey AS score_id, c_mktsegment AS sub_industry,
    CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN n_name END AS country,
    CAST(CASE o_orderstatus WHEN 'F' THEN 5 WHEN 'O' THEN 10 ELSE 20 END AS BIGINT) AS horizon,
    CAST(year(o_orderdate) AS BIGINT) AS year,
    least(100.0, o_totalprice / 5000) AS score, o_orderdate AS created_at
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "entity_components": "SELECT l_orderkey AS entity_id, "
    + ", ".join(f"round({e}, 6) AS {n}" for n, e in COMPONENTS.items())
    + " FROM lineitem GROUP BY l_orderkey",
    "component_long": "UNPIVOT entity_components ON " + ", ".join(COMPONENTS) + " INTO NAME metric VALUE value",
    "crawl_current": """SELECT s_suppkey AS site_id, s_name AS name, n_name AS country, s_acctbal AS capacity
FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_nationkey <> 7""",
    "crawl_previous": """SELECT s_suppkey AS site_id, s_name AS name, n_name AS country,
    CASE WHEN s_acctbal < 1000 THEN s_acctbal + 1 ELSE s_acctbal END AS capacity
FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal < 9000""",
    "gappy": """SELECT event_id, user_id, ts, CASE WHEN event_type <> 'error' THEN value END AS value FROM events""",
    "formula_inputs": "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, "
    + ", ".join(f"{e} AS {n}" for n, e in FORMULA_INPUTS.items())
    + " FROM lineitem",
    "active_weights": """SELECT metric_slug, CAST(weight_value AS DOUBLE) AS weight_value FROM (VALUES ('necessity_score', 0.6), ('emissions_score', 0.9),
    ('economic_score', 0.3), ('ecological_score', 0.0), ('monopoly_control_score', 1.4)) AS w(metric_slug, weight_value)""",
    "messages": """SELECT conv_id, turn, role, text, CAST(length(text) % 500 AS BIGINT) AS response_ms,
    TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CAST(conv_id * 3600 + turn * 30 AS BIGINT)) AS created_at
FROM conversations""",
    "feed_points": """SELECT n_name AS country, CAST(year(o_orderdate) AS BIGINT) AS y, o_orderstatus AS series,
    count(*) AS n, CAST(sum(floor(o_totalprice)) AS BIGINT) AS amount
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3""",
    "feed_payloads": """SELECT 'IEA' AS source, 'COALPROD' AS dataset, NULL::VARCHAR AS indicator, NULL::VARCHAR AS series_id,
    NULL::VARCHAR AS commodity_code, country, NULL::BIGINT AS year, CASE WHEN country = 'NATION_3' THEN '{"status":"error"}' ELSE
    concat('{"data":[', string_agg(concat('{"country":"', country, '","product":"COAL","year":', y, ',"value":', n,
      ',"unit":"orders"}'), ',' ORDER BY y), '],"status":"success"}') END AS data
  FROM (SELECT country, y, CAST(sum(n) AS BIGINT) AS n FROM feed_points GROUP BY 1, 2) GROUP BY country
UNION ALL SELECT 'EIA', NULL, NULL, series, NULL, NULL, NULL, concat('{"response":{"data":[', string_agg(concat('{"period":"', y,
      '","seriesId":"', series, '","value":', n, ',"units":"orders"}'), ',' ORDER BY y), ']}}')
  FROM (SELECT series, y, CAST(sum(n) AS BIGINT) AS n FROM feed_points GROUP BY 1, 2) GROUP BY series
UNION ALL SELECT 'WorldBank', NULL, 'NY.GDP.MKTP.CD', NULL, NULL, country, NULL, CASE WHEN country = 'NATION_5' THEN '[null]' ELSE
    concat('[null,[', string_agg(concat('{"indicator":{"id":"NY.GDP.MKTP.CD","value":"GDP"},"country":{"id":"', country,
      '","value":"', country, '"},"countryiso3code":"', country, '","date":"', y, '","value":', amount, ',"unit":"USD"}'), ',' ORDER BY y), ']]') END
  FROM (SELECT country, y, CAST(sum(amount) AS BIGINT) AS amount FROM feed_points GROUP BY 1, 2) GROUP BY country
UNION ALL SELECT 'UNComtrade', NULL, NULL, NULL, '2701', NULL, y, concat('{"data":[', string_agg(concat('{"period":"', y,
      '","reporterCode":"', country, '","cmdCode":"2701","flowCode":"X","tradeValue":', amount, ',"netWeight":', n, '}'), ',' ORDER BY country), ']}')
  FROM (SELECT country, y, CAST(sum(amount) AS BIGINT) AS amount, CAST(sum(n) AS BIGINT) AS n FROM feed_points GROUP BY 1, 2) GROUP BY y
UNION ALL SELECT 'IMF', NULL, 'ENDA', NULL, NULL, country, NULL, concat('{"values":{"ENDA":{"', country, '":[',
      string_agg(concat('{"year":', y, ',"value":', n, '}'), ',' ORDER BY y), ']}}}')
  FROM (SELECT country, y, CAST(sum(n) AS BIGINT) AS n FROM feed_points GROUP BY 1, 2) GROUP BY country""",
    "reference_notes": """SELECT p_partkey AS definition_id, concat('USGS table ', p_name, CASE WHEN p_size % 2 = 0 THEN ' R/P Ratio' ELSE '' END,
    CASE WHEN p_size % 3 = 0 THEN concat('. Reskilling Cost about ', p_size, '00 USD') ELSE '' END,
    CASE WHEN p_size % 5 = 0 THEN concat('. learning rate is ', p_size, '.5% and HHI current ', p_size * 3) ELSE '' END,
    CASE WHEN p_size % 7 = 0 THEN concat('. Patents FiveYearCAGR ', p_size, '%; Asset Life Remaining ', p_size, ' years') ELSE '' END) AS details
FROM part""",
    "site_payloads": """SELECT country, page, CASE WHEN country IN ('NATION_2', 'NATION_4') THEN concat('[', items, ']')
    WHEN country = 'NATION_6' THEN '{"other":1}' ELSE concat('{"mines":[', items, ']}') END AS payload
FROM (SELECT n_name AS country, s_suppkey // 100 AS page, string_agg(concat('{"name":"', s_name, '","site":', s_suppkey, '}'), ',' ORDER BY s_suppkey) AS items
  FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2)""",
    "chat_prompts": """SELECT conv_id, turn, role, concat(CASE turn % 8 WHEN 0 THEN 'Please EXPLAIN this: ' WHEN 1 THEN 'What if coal falls? '
    WHEN 2 THEN 'Compare emissions: ' WHEN 3 THEN 'Forecast economic output: ' WHEN 4 THEN 'Best ten: ' WHEN 5 THEN 'Which methodology? '
    ELSE '' END, text) AS message FROM conversations""",
    "clean_documents": """SELECT doc_id, source, regexp_replace(array_to_string(list_filter(list_transform(string_split(text, chr(10)),
    lambda x: regexp_replace(x, '^{BLANK}+|{BLANK}+$', '', 'g')), lambda x: x <> ''), chr(10)), ' {2,}', ' ', 'g') AS clean FROM documents""",
    "centroid": """SELECT list(m ORDER BY i) AS centre FROM (SELECT i, avg(v) AS m FROM (SELECT unnest(embedding)::DOUBLE AS v,
    unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY i)""",
}
