"""Formula catalogue, refinement layers and feature tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from seamline import fixed
from seamline.functions import dates, nested
from seamline.functions import text as tx
from seamline.operators import relational as rel
from seamline.operators import windows as win
from seamline.plans import features, formulas, medallion, quality
from seamline.session import scratch
from seamline.sources import feeds
from seamline.workloads import standins as st
from seamline.workloads.registry import query
from seamline.workloads.scalars import KEY_SQL, P, SLUG_SQL
from seamline.workloads.sources import FLAT_SQL


def _z(c):
    return f"(({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER ())"


FORMULA_SQL = {
    "f_01_energy_security_factor": "100 * (ln(1 + E_primary_coal_share) / ln(101))",
    "f_01_baseload_dependency": "100 * (Coal_baseload_share / nullif(Total_baseload_capacity, 0))",
    "f_01_economic_criticality": "100 * (Coal_GDP_contribution / nullif(Total_energy_GDP, 0))",
    "f_02_scarcity_factor": "100 * (1 - RPR_ratio_normalised)",
    "f_02_extraction_difficulty": "100 * (1 - Accessible_reserves / nullif(Total_reserves, 0))",
    "f_02_grade_decline": "100 * (1 - Current_grade / nullif(Historical_average_grade, 0))",
    "f_03_subsidy_factor": "100 * (Direct_Subsidies_GDPpct + Tax_Expenditure_GDPpct)",
    "f_03_policy_support": "100 * (Policy_support_score / nullif(Max_policy_score, 0))",
    "f_03_market_distortion": "100 * (Artificial_price_support / nullif(Market_price, 0))",
    "f_04_co2_intensity": f"100 * (1 - {_z('CO2_t_per_MWh')})",
    "f_04_methane_factor": f"100 * (1 - {_z('CH4_emissions_factor')})",
    "f_04_carbon_cost_exposure": "100 * (Carbon_price_USD_per_t * Emissions_intensity)",
    "f_05_land_water_impact": f"100 * ({_z('Biodiversity_risk')} + {_z('Water_stress_factor')}) / 2",
    "f_05_air_quality_impact": f"100 * (1 - {_z('PM25_emissions_factor')})",
    "f_05_ecosystem_disruption": f"100 * (1 - {_z('Ecosystem_impact_score')})",
    "f_08_reskilling_burden": "100 / (1 + exp(-(Reskill_USD_per_worker / nullif(GDP_pc, 0))))",
    "f_08_employment_intensity": "100 * (Coal_jobs_per_GWh / nullif(Industry_avg_jobs_per_GWh, 0))",
    "f_08_transition_cost": "100 * (Transition_cost_total / nullif(Regional_GDP, 0))",
    "f_09_stranded_asset_risk": "100 * (1 - Years_remaining / nullif(Nominal_life, 0))",
    "f_09_repurposing_potential": "100 * (Repurposing_score / nullif(Max_repurposing_score, 0))",
    "f_09_infrastructure_age": "100 * (Current_age / nullif(Design_life, 0))",
    "f_11_hhi_dominance": "100 * (HHI / 10000)",
    "f_11_market_concentration": "100 * (Top4_market_share / 100)",
    "f_11_pricing_power": "100 * (Price_markup / nullif(Competitive_benchmark, 0))",
    "f_20_profit_resilience": f"100 * ({_z('EBIT_margin')} + {_z('Price_volatility')}) / 2",
    "f_20_capex_intensity": f"100 * (1 - {_z('CAPEX_per_MW')})",
    "f_20_opex_competitiveness": f"100 * (1 - {_z('OPEX_per_MWh')})",
    "f_24_substitute_maturity": "100 * (1 - LCOE_coal / nullif(LCOE_alternatives, 0))",
    "f_24_innovation_rate": f"100 * (1 - {_z('Patent_growth_rate')})",
    "f_24_technology_gap": "100 * (1 - Performance_gap / nullif(Historical_gap, 0))",
}


def _digits(name):
    """Column-wide deviations differ in the last bits between engines."""
    return 4 if "OVER" in FORMULA_SQL[name] else 6


DIGITS = {n: _digits(n) for n in FORMULA_SQL}


def _cells(names):
    return ", ".join(f"round({FORMULA_SQL[n]}, {_digits(n)}) AS {n}" for n in names)


def _rounded(names):
    return [F.round(n, _digits(n)).alias(n) for n in names]


def _register_formula(name: str, text: str) -> None:
    @query(f"formula_{name.removeprefix('f_')}", f"SELECT l_orderkey, l_linenumber, {_cells([name])} FROM formula_inputs", digits={name: _digits(name)})
    def one_formula(spark, sf):
        inputs = formulas.variables(text)
        frame = st.formula_inputs(spark, sf).select("l_orderkey", "l_linenumber", *inputs)
        return formulas.with_formulas(frame, {name: text}).select("l_orderkey", "l_linenumber", name)


for _name, _text in formulas.catalogue().items():
    _register_formula(_name, _text)


SHEET_04 = [n for n in FORMULA_SQL if n.startswith("f_04")]


@query("p01_one_sheet", f"SELECT l_orderkey, l_linenumber, {_cells(SHEET_04[1:])}, CAST(NULL AS DOUBLE) AS f_04_co2_intensity FROM formula_inputs", digits=DIGITS)
def one_sheet(spark, sf):
    """An input column is missing: its formula gives NULL, the others go on."""
    frame = formulas.sheet_metrics(st.formula_inputs(spark, sf).drop("CO2_t_per_MWh"), "04")
    return frame.select("l_orderkey", "l_linenumber", *SHEET_04)


@query("p02_all_sheets", f"SELECT l_orderkey, l_linenumber, {_cells(FORMULA_SQL)} FROM formula_inputs", digits=DIGITS)
def all_sheets(spark, sf):
    return formulas.all_metrics(st.formula_inputs(spark, sf)).select("l_orderkey", "l_linenumber", *FORMULA_SQL)


@query("p03_user_formula", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(sqrt(l_extendedprice / nullif(l_quantity, 0)) * (1 - l_discount) - greatest(l_tax, 0.02) ** 2, 6) AS result,
  CAST(NULL AS DOUBLE) AS refused FROM lineitem
""")
def user_formula(spark, sf):
    frame = st.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    scored = formulas.user_formula(frame, "sqrt(l_extendedprice / l_quantity) * (1 - l_discount) - max(l_tax, 0.02) ** 2")
    refused = formulas.user_formula(scored, "__import__('os').getcwd()", "refused")
    return refused.select("l_orderkey", "l_linenumber", "result", "refused")


@query("p04_raw_to_bronze", FLAT_SQL + """SELECT source, key, period, value, unit, lower(source) AS source_name,
  TIMESTAMP '2024-01-31 06:00:00' AS ingest_date, 'v1' AS data_version FROM flat WHERE error IS NULL""")
def raw_to_bronze(spark, sf):
    at = dates.stamp("2024-01-31 06:00:00")
    return medallion.bronze_of_all(st.feed_payloads(spark, sf), at, "v1", scratch(spark, "bronze"))


def _bronze_orders(spark, sf):
    """Bronze rows with repeats, text numbers and text dates."""
    orders = st.table(spark, sf, "orders")
    rows = orders.select(
        "o_orderkey", F.col("o_totalprice").cast("string").alias("order_value"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"),
        F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.col("o_custkey").cast("string")).alias("buyer_amount"),
        F.col("o_totalprice").alias("weight_tonnes"), F.col("o_orderstatus").alias("data_type"),
    )
    return rows.unionByName(rows.where("data_type = 'F'"))


@query("p05_bronze_to_silver", """
SELECT o_orderkey, o_totalprice AS order_value, o_orderdate AS order_date, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_custkey AS DOUBLE) END AS buyer_amount,
  round(o_totalprice * 0.001, 6) AS weight_tonnes, o_orderstatus AS data_type FROM orders
""")
def bronze_to_silver(spark, sf):
    table = medallion.silver(_bronze_orders(spark, sf), {"weight_tonnes": 0.001})
    return medallion.store(table, scratch(spark, "silver"), medallion.silver_name("raw_orders_raw_data"))


@query("p06_silver_to_gold", """
WITH u AS (SELECT 'supplier' AS source, s_suppkey AS id, s_acctbal AS CAPEX_per_MW, CAST(s_nationkey AS DOUBLE) AS OPEX_per_MWh FROM supplier
UNION ALL SELECT 'customer', c_custkey, c_acctbal, NULL FROM customer)
SELECT source, id, round(100 * (1 - (CAPEX_per_MW - avg(CAPEX_per_MW) OVER ()) / stddev_samp(CAPEX_per_MW) OVER ()), 6) AS f_20_capex_intensity,
  round(100 * (1 - (OPEX_per_MWh - avg(OPEX_per_MWh) OVER ()) / stddev_samp(OPEX_per_MWh) OVER ()), 6) AS f_20_opex_competitiveness FROM u
""")
def silver_to_gold(spark, sf):
    c = F.col
    tables = {
        "supplier": st.table(spark, sf, "supplier").select(
            c("s_suppkey").alias("id"), c("s_acctbal").alias("CAPEX_per_MW"), c("s_nationkey").cast("double").alias("OPEX_per_MWh")),
        "customer": st.table(spark, sf, "customer").select(c("c_custkey").alias("id"), c("c_acctbal").alias("CAPEX_per_MW")),
    }
    frame = medallion.store(medallion.gold(tables, ["20"]), scratch(spark, "gold"), "gold_metrics")
    return frame.select("source", "id", "f_20_capex_intensity", "f_20_opex_competitiveness")


DERIVED_SQL = """SELECT mine_id, feature_date, production_mt / nullif(capacity_mt, 0) AS f_capacity_utilization_rate,
  revenue / nullif(production_mt, 0) AS f_revenue_per_mt, (revenue - operating_cost) / nullif(revenue, 0) AS f_operating_margin,
  incidents * 1000.0 / nullif(n_events, 0) AS f_safety_incident_rate, carbon / nullif(production_mt, 0) AS f_carbon_intensity,
  reserves / nullif(production_mt, 0) AS f_reserve_life_years, esg_score FROM gold_features"""


@query("p07_derived_ratios", f"SELECT mine_id, feature_date, {', '.join(f'round({c}, 6) AS {c}' for c in fixed.DERIVED_FEATURES)} FROM ({DERIVED_SQL})")
def derived_ratios(spark, sf):
    return features.with_derived(st.gold_features(spark, sf)).select("mine_id", "feature_date", *fixed.DERIVED_FEATURES)


BANDS = {
    "utilization_category": ("f_capacity_utilization_rate", [0.5, 0.8], ["low", "medium", "high"]),
    "esg_category": ("esg_score", [10.0, 25.0], ["poor", "fair", "good"]),
    "carbon_intensity_category": ("f_carbon_intensity", [0.1, 0.3], ["low", "medium", "high"]),
}


@query("p08_category_bands", f"""
SELECT mine_id, feature_date,
  CASE WHEN f_capacity_utilization_rate IS NULL THEN NULL WHEN f_capacity_utilization_rate < 0.5 THEN 'low' WHEN f_capacity_utilization_rate < 0.8 THEN 'medium' ELSE 'high' END AS utilization_category,
  CASE WHEN esg_score IS NULL THEN NULL WHEN esg_score < 10 THEN 'poor' WHEN esg_score < 25 THEN 'fair' ELSE 'good' END AS esg_category,
  CASE WHEN f_carbon_intensity IS NULL THEN NULL WHEN f_carbon_intensity < 0.1 THEN 'low' WHEN f_carbon_intensity < 0.3 THEN 'medium' ELSE 'high' END AS carbon_intensity_category
FROM ({DERIVED_SQL})
""")
def category_bands(spark, sf):
    frame = features.with_bands(features.with_derived(st.gold_features(spark, sf)), BANDS)
    return frame.select("mine_id", "feature_date", *BANDS)


@query("p09_historical_features", """
SELECT mine_id, feature_date, production_mt AS f_production_volume, capacity_mt AS f_capacity_volume, esg_score AS f_sustainability_score FROM gold_features
WHERE feature_date BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-22' AND feature_freshness_score >= 0.7 ORDER BY mine_id, feature_date
""")
def historical_features(spark, sf):
    wanted = ["f_production_volume", "f_capacity_volume", "f_sustainability_score"]
    since, until = dates.stamp("2024-01-08"), dates.stamp("2024-01-22")
    rows = features.historical(st.gold_features(spark, sf, since, until), since, until, wanted)
    return rows.orderBy("mine_id", "feature_date")


@query("p10_online_features", """
WITH recent AS (SELECT *, row_number() OVER (PARTITION BY mine_id ORDER BY feature_date DESC) AS rn FROM gold_features
  WHERE feature_date >= TIMESTAMP '2024-01-20' - INTERVAL 7 DAY)
SELECT c_custkey AS mine_id, feature_date, production_mt AS f_production_volume, esg_score AS f_sustainability_score
FROM customer LEFT JOIN recent ON c_custkey = mine_id AND rn = 1
""")
def online_features(spark, sf):
    requests = st.table(spark, sf, "customer").select(F.col("c_custkey").alias("mine_id"))
    wanted = ["f_production_volume", "f_sustainability_score"]
    as_of = dates.stamp("2024-01-20")
    return features.online(st.gold_features(spark, sf, as_of - F.make_dt_interval(F.lit(7))), requests, as_of, wanted)


@query("p11_published_scores", """
WITH r AS (SELECT score_id, sub_industry, score, percent_rank() OVER (PARTITION BY sub_industry ORDER BY score) * 100 AS percentile FROM composite_scores)
SELECT score_id, sub_industry, h AS horizon, concat('s_', regexp_replace(lower(sub_industry), '[^a-z_]', '', 'g'), '_', h) AS score_name,
  round(score, 6) AS score, round(percentile, 6) AS percentile FROM r, (VALUES ('H5'), ('H10'), ('H20')) t(h)
""")
def published_scores(spark, sf):
    scores = st.composite_scores(spark, sf).select("score_id", "sub_industry", "score")
    return medallion.published_scores(scores, "sub_industry", "score").withColumnRenamed("horizon_name", "horizon")


@query("p12_quality_report", """
WITH as_of AS (SELECT TIMESTAMP '2024-01-31' AS t), r AS (
SELECT 'orders' AS table_name, count(*) AS rows, 1.0::DOUBLE AS completeness, count(DISTINCT o_orderkey) / count(*) AS uniqueness,
  (epoch_us((SELECT t FROM as_of)) - epoch_us(max(o_orderdate))) / 3600000000.0 AS lag_hours FROM orders
UNION ALL SELECT 'lineitem', count(*), 1.0, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) / count(*),
  (epoch_us((SELECT t FROM as_of)) - epoch_us(max(l_shipdate))) / 3600000000.0 FROM lineitem
UNION ALL SELECT 'gappy', count(*), (count(event_id) + count(user_id) + count(ts) + count(value)) / (4 * count(*)), count(DISTINCT event_id) / count(*),
  (epoch_us((SELECT t FROM as_of)) - epoch_us(max(ts))) / 3600000000.0 FROM gappy),
f AS (SELECT *, completeness >= 0.95 AS complete, lag_hours <= 24 AS fresh, uniqueness >= 0.99 AS "unique" FROM r)
SELECT table_name, rows, round(completeness, 6) AS completeness, round(uniqueness, 6) AS uniqueness, round(lag_hours, 6) AS lag_hours,
  complete, fresh, "unique", CASE WHEN complete::INT + fresh::INT + "unique"::INT = 3 THEN 'Excellent' ELSE 'Needs Improvement' END AS band FROM f
""")
def quality_report(spark, sf):
    as_of = dates.stamp("2024-01-31")
    reports = [
        quality.table_report(st.table(spark, sf, "orders"), "orders", ["o_orderkey"], "o_orderdate", as_of),
        quality.table_report(st.table(spark, sf, "lineitem"), "lineitem", ["l_orderkey", "l_linenumber"], "l_shipdate", as_of),
        quality.table_report(st.gappy(spark, sf), "gappy", ["event_id"], "ts", as_of),
    ]
    return reports[0].unionByName(reports[1]).unionByName(reports[2])


@query("p13_catalogue_audit", f"""
WITH k AS (SELECT *, {KEY_SQL} AS metric_key FROM metric_definitions),
a AS (SELECT definition_id, metric_key, regexp_matches(metric_key, '{P['metric_key']}') AS name_ok, array_to_string(list_filter([
  CASE WHEN coalesce(trim(title), '') = '' THEN 'title' END, CASE WHEN coalesce(readiness_status, '') = '' THEN 'readiness_status' END,
  CASE WHEN volume_of_data IS NULL THEN 'volume_of_data' END], lambda x: x IS NOT NULL), ',') AS missing FROM k)
SELECT *, name_ok AND missing = '' AS is_valid FROM a
""")
def catalogue_audit(spark, sf):
    key = tx.metric_key(F.col("sheet_name"), F.col("raw_slug"))
    return quality.catalogue_audit(st.metric_definitions(spark, sf), key, ["title", "readiness_status", "volume_of_data"])


LINEAGE_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS feature, 'double' AS dtype, '{c}' AS category, '{u}' AS unit, count({n}) AS non_null FROM d"
    for n, (c, u) in fixed.DERIVED_FEATURES.items()
)


@query("p14_feature_lineage", f"WITH d AS ({DERIVED_SQL}) SELECT *, 'gold_features' AS source_table, '1.0' AS version FROM ({LINEAGE_SQL})")
def feature_lineage(spark, sf):
    """Lineage rows with the number of values each feature really has."""
    frame = features.with_derived(st.gold_features(spark, sf))
    lineage = features.lineage(frame, "gold_features", "1.0")
    counts = frame.agg(*[F.count(c).alias(c) for c in fixed.DERIVED_FEATURES]).unpivot([], list(fixed.DERIVED_FEATURES), "feature", "non_null")
    return lineage.join(counts, "feature")


@query("p15_filled_and_normalised", """
WITH f AS (SELECT event_id, coalesce(value, avg(value) OVER ()) AS v, coalesce(CASE WHEN user_id > 5 THEN user_id::DOUBLE END,
  avg(CASE WHEN user_id > 5 THEN user_id::DOUBLE END) OVER ()) AS u FROM gappy)
SELECT event_id, round((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) * 100, 6) AS value,
  round((u - min(u) OVER ()) / (max(u) OVER () - min(u) OVER ()) * 100, 6) AS user_score FROM f
""")
def filled_and_normalised(spark, sf):
    frame = st.gappy(spark, sf).select("event_id", "value", F.when(F.col("user_id") > 5, F.col("user_id").cast("double")).alias("user_score"))
    return win.fill_and_normalise(frame, ["value", "user_score"], "mean", "min_max")


CATALOGUE_SQL = " UNION ALL ".join(
    f"SELECT '{s}' AS sheet, '{slug}' AS slug, '{text}' AS formula, count(f_{s}_{slug}) AS non_null FROM m"
    for s, ms in fixed.FORMULAS.items() for slug, text in ms.items()
)


@query("p16_formula_catalogue", f"""WITH m AS (SELECT {_cells(FORMULA_SQL)} FROM formula_inputs), c AS ({CATALOGUE_SQL})
SELECT *, count(*) OVER (PARTITION BY sheet) AS sheet_count FROM c""")
def formula_catalogue(spark, sf):
    """The catalogue with the number of rows each formula has a value for."""
    frame = formulas.all_metrics(st.formula_inputs(spark, sf))
    counts = frame.agg(*[F.count(c).alias(c) for c in FORMULA_SQL]).unpivot([], list(FORMULA_SQL), "feature", "non_null")
    rows = [(f"f_{s}_{slug}", s, slug, text, len(ms)) for s, ms in fixed.FORMULAS.items() for slug, text in ms.items()]
    table = spark.createDataFrame(rows, "feature string, sheet string, slug string, formula string, sheet_count bigint")
    return table.join(counts, "feature").drop("feature")


@query("p17_standard_names", f"""
SELECT definition_id, h AS horizon, {KEY_SQL} AS metric_key, concat('f_', {KEY_SQL}) AS feature_column, concat('w_', {KEY_SQL}, '_', h) AS weight_column,
  concat('s_coal_', h) AS score_column, concat('raw_', {SLUG_SQL.format('title')}, '_topic') AS dataset_table
FROM metric_definitions, (VALUES ('H5'), ('H10'), ('H20')) t(h)
""")
def standard_names(spark, sf):
    key, horizon = tx.metric_key(F.col("sheet_name"), F.col("raw_slug")), F.col("horizon")
    return rel.with_each(st.metric_definitions(spark, sf), "horizon", fixed.HORIZONS).select(
        "definition_id", "horizon", key.alias("metric_key"), tx.feature_name(key).alias("feature_column"),
        tx.weight_name(key, horizon).alias("weight_column"), tx.score_name(F.lit("coal"), horizon).alias("score_column"),
        tx.dataset_name(F.col("title"), F.lit("topic")).alias("dataset_table"),
    )


JOB = [n for n in FORMULA_SQL if n.startswith(("f_11", "f_20"))]


@query("p18_metric_job", f"WITH m AS (SELECT l_orderkey, l_linenumber, {_cells(JOB)} FROM formula_inputs) SELECT *, '{','.join(JOB)}' AS feature_list FROM m", digits=DIGITS)
def metric_job(spark, sf):
    frame = formulas.sheet_metrics(formulas.sheet_metrics(st.formula_inputs(spark, sf), "11"), "20")
    made = rel.columns_with_prefix(frame, "f_")
    return frame.select("l_orderkey", "l_linenumber", *made, F.lit(",".join(made)).alias("feature_list"))


@query("u01_user_expression", "SELECT score_id, round(100 / (1 + exp(-score)), 6) AS result FROM composite_scores")
def user_expression(spark, sf):
    return formulas.user_formula(st.composite_scores(spark, sf), "100 * sigmoid(score)").select("score_id", "result")


@query("u02_registered_features", "SELECT mine_id, feature_date, round(revenue * 2, 6) AS f_double, round(revenue / nullif(carbon, 0), 6) AS f_ratio FROM gold_features")
def registered_features(spark, sf):
    registry = features.FeatureRegistry()
    registry.register("f_double", F.col("revenue") * 2)
    registry.register("f_ratio", F.try_divide("revenue", "carbon"))
    return registry.apply(st.gold_features(spark, sf)).select("mine_id", "feature_date", "f_double", "f_ratio")
