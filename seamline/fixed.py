"""Constants the results depend on. Data only, no logic."""

# Sheet name -> two-digit sheet number.
SHEET_NUMBERS = {
    "1 Necessity Score (Core)": "01",
    "2 Resource Extraction & Scarcity Score": "02",
    "3 Artificial Support Score": "03",
    "4 Emissions Score": "04",
    "5 Ecological Score": "05",
    "8 Workforce Transition Score": "08",
    "9 Infrastructure Repurposing Score": "09",
    "11 Monopoly & Corporate Control Score": "11",
    "20 Economic Score": "20",
    "24. Technological Disruption Score": "24",
}

# Sheet name -> theme.
SHEET_THEMES = {
    "1 Necessity Score (Core)": "Social & economic indispensability of coal today",
    "2 Resource Extraction & Scarcity Score": "How hard & costly it is to obtain coal going forward",
    "3 Artificial Support Score": "Degree of subsidies, bail-outs, mandates keeping coal alive",
    "4 Emissions Score": "GHG impact & regulatory exposure",
    "5 Ecological Score": "Wider environmental externalities (land, water, biodiversity)",
    "8 Workforce Transition Score": "Reskilling cost & labour-market rigidity",
    "9 Infrastructure Repurposing Score": "How easily coal assets can be repurposed",
    "11 Monopoly & Corporate Control Score": "Market structure & pricing power",
    "20 Economic Score": "Profitability & macro-exposure (prices, GDP elasticity)",
    "24. Technological Disruption Score": "Threat of substitutes (e.g. renewables, CCS)",
}

# Sheet-name prefix -> composite score name.
SCORE_NAME_BY_PREFIX = {
    "1 ": "Necessity Score",
    "2 ": "Resource Extraction & Scarcity Score",
    "3 ": "Artificial Support Score",
    "4 ": "Emissions Score",
    "5 ": "Ecological Score",
    "8 ": "Workforce Transition Score",
    "9 ": "Infrastructure Repurposing Score",
    "11 ": "Monopoly & Corporate Control Score",
    "20 ": "Economic Score",
    "24": "Technological Disruption Score",
}

# Forecast horizons.
HORIZONS = ["H5", "H10", "H20"]

# Name patterns.
NAME_PATTERNS = {
    "metric_key": r"^(\d{2})_([a-z_]+)$",
    "dataset_table": r"^raw_([a-z_]+)_([a-z_]+)$",
    "feature_column": r"^f_(\d{2})_([a-z_]+)$",
    "weight_column": r"^w_(\d{2})_([a-z_]+)_(H5|H10|H20)$",
    "composite_score": r"^s_([a-z_]+)_(H5|H10|H20)$",
}

# Sheet number -> metric slug -> formula.
FORMULAS = {
    "01": {
        "energy_security_factor": "100 * (log1p(E_primary_coal_share) / log1p(100))",
        "baseload_dependency": "100 * (Coal_baseload_share / Total_baseload_capacity)",
        "economic_criticality": "100 * (Coal_GDP_contribution / Total_energy_GDP)",
    },
    "02": {
        "scarcity_factor": "100 * (1 - RPR_ratio_normalised)",
        "extraction_difficulty": "100 * (1 - (Accessible_reserves / Total_reserves))",
        "grade_decline": "100 * (1 - (Current_grade / Historical_average_grade))",
    },
    "03": {
        "subsidy_factor": "100 * (Direct_Subsidies_GDPpct + Tax_Expenditure_GDPpct)",
        "policy_support": "100 * (Policy_support_score / Max_policy_score)",
        "market_distortion": "100 * (Artificial_price_support / Market_price)",
    },
    "04": {
        "co2_intensity": "100 * (1 - zscore(CO2_t_per_MWh))",
        "methane_factor": "100 * (1 - zscore(CH4_emissions_factor))",
        "carbon_cost_exposure": "100 * (Carbon_price_USD_per_t * Emissions_intensity)",
    },
    "05": {
        "land_water_impact": "100 * avg(zscore(Biodiversity_risk), zscore(Water_stress_factor))",
        "air_quality_impact": "100 * (1 - zscore(PM25_emissions_factor))",
        "ecosystem_disruption": "100 * (1 - zscore(Ecosystem_impact_score))",
    },
    "08": {
        "reskilling_burden": "100 * sigmoid(Reskill_USD_per_worker / GDP_pc)",
        "employment_intensity": "100 * (Coal_jobs_per_GWh / Industry_avg_jobs_per_GWh)",
        "transition_cost": "100 * (Transition_cost_total / Regional_GDP)",
    },
    "09": {
        "stranded_asset_risk": "100 * (1 - (Years_remaining / Nominal_life))",
        "repurposing_potential": "100 * (Repurposing_score / Max_repurposing_score)",
        "infrastructure_age": "100 * (Current_age / Design_life)",
    },
    "11": {
        "hhi_dominance": "100 * (HHI / 10000)",
        "market_concentration": "100 * (Top4_market_share / 100)",
        "pricing_power": "100 * (Price_markup / Competitive_benchmark)",
    },
    "20": {
        "profit_resilience": "100 * (zscore(EBIT_margin) + zscore(Price_volatility)) / 2",
        "capex_intensity": "100 * (1 - zscore(CAPEX_per_MW))",
        "opex_competitiveness": "100 * (1 - zscore(OPEX_per_MWh))",
    },
    "24": {
        "substitute_maturity": "100 * (1 - (LCOE_coal / LCOE_alternatives))",
        "innovation_rate": "100 * (1 - zscore(Patent_growth_rate))",
        "technology_gap": "100 * (1 - (Performance_gap / Historical_gap))",
    },
}

# Names a formula may call.
FORMULA_FUNCTIONS = ["log1p", "zscore", "sigmoid", "avg", "max", "min", "exp", "log", "sqrt", "abs"]

# Data-quality components.
QUALITY_COMPONENTS = {"freshness": 0.4, "coverage": 0.3, "confidence": 0.3}

# Weights of the ten component scores.
COMPONENT_WEIGHTS = {
    "necessity_score": 0.15,
    "resource_scarcity_score": 0.10,
    "artificial_support_score": 0.10,
    "emissions_score": 0.15,
    "ecological_score": 0.10,
    "workforce_transition_score": 0.10,
    "infrastructure_repurposing_score": 0.10,
    "monopoly_control_score": 0.05,
    "economic_score": 0.10,
    "technological_disruption_score": 0.05,
}

# Intent -> keywords, tested in this order.
INTENT_KEYWORDS = {
    "explain": ["why", "explain", "reason"],
    "scenario": ["what if", "scenario", "change"],
    "compare": ["compare", "versus", "vs"],
    "predict": ["predict", "forecast", "future"],
    "rank": ["rank", "ranking", "top", "best", "worst"],
    "data_inquiry": ["data", "source", "methodology"],
}

# Keyword -> topic.
TOPIC_KEYWORDS = {
    "coal": "Coal Industry",
    "emission": "Emissions",
    "economic": "Economic Factors",
    "scenario": "Scenario Analysis",
}

# Reference patterns searched in free text, ignoring case.
REFERENCE_PATTERNS = {
    "usgs_data": r"USGS.*?R/P Ratio",
    "oecd_subsidy": r"OECD.*?ETP.*?Subsidy",
    "imf_tax": r"IMF.*?Tax Expenditure",
    "reskilling_cost": r"Reskilling Cost.*?(\d+).*?USD",
    "unionisation_rate": r"Unionisation.*?Rate.*?(\d+\.?\d*)%",
    "asset_life": r"Asset Life.*?Remaining.*?(\d+).*?years",
    "hhi_current": r"HHI.*?current.*?(\d+\.?\d*)",
    "learning_rate": r"Learning Rate.*?(\d+\.?\d*)%",
    "patents_cagr": r"Patents.*?FiveYearCAGR.*?(\d+\.?\d*)%",
}

# Storage column -> feature name.
FEATURE_NAMES = {
    "production_mt": "f_production_volume",
    "capacity_mt": "f_capacity_volume",
    "capacity_utilization_rate": "f_capacity_utilization_rate",
    "esg_score": "f_sustainability_score",
    "carbon_intensity_tco2_per_mt": "f_carbon_intensity",
    "revenue_per_mt": "f_revenue_per_mt",
    "operating_margin": "f_operating_margin",
    "safety_incident_rate_per_1000_employees": "f_safety_incident_rate",
    "reserve_life_years": "f_reserve_life_years",
    "total_carbon_emissions_tco2": "f_total_carbon_emissions",
    "productivity_mt_per_employee": "f_productivity_per_employee",
    "latitude_abs": "f_geographic_risk",
    "metric_year": "f_temporal_trend",
    "metric_quarter": "f_seasonal_pattern",
    "metric_month": "f_monthly_cycle",
}

# Storage column -> metric slug of weights.
METRIC_SLUGS = {
    "production_mt": "production_volume",
    "capacity_utilization_rate": "operational_efficiency",
    "esg_score": "sustainability_score",
    "carbon_intensity_tco2_per_mt": "carbon_footprint",
    "revenue_per_mt": "profitability",
    "operating_margin": "cost_efficiency",
    "safety_incident_rate_per_1000_employees": "safety_performance",
    "reserve_life_years": "resource_longevity",
    "total_carbon_emissions_tco2": "environmental_impact",
    "productivity_mt_per_employee": "labor_productivity",
    "latitude_abs": "geographic_risk",
    "metric_year": "temporal_trend",
    "metric_quarter": "seasonal_pattern",
    "metric_month": "monthly_cycle",
}

# Header -> field of the data-source sheet.
SOURCE_SHEET_FIELDS = {
    "Name": "name",
    "Source Link": "source_link",
    "Description": "description",
    "LV 3 GICS Schema": "gics_schema",
    "Frequency": "frequency",
    "Currency": "currency",
    "Update Lag_days": "update_lag_days",
    "Type": "data_type",
    "Data Format": "data_format",
    "Region": "region",
    "Country": "country",
    "Category": "category",
    "Sub-Category": "sub_category",
    "Lifespan": "lifespan",
    "API": "api_available",
    "Github": "github_repo",
    "File Format": "file_format",
    "File": "file_path",
    "Source": "source_author",
    "License": "license_type",
    "NON-GICS Sector": "non_gics_sector",
}

# Header -> field of a metric sheet.
METRIC_SHEET_FIELDS = {
    "ID Number": "id_number",
    "Title": "title",
    "METRIC": "metric_slug",
    "Details": "details",
    "Data Fields required": "data_fields_required",
    "Formula": "formula",
    "Weighting In Metric": "weighting_in_metric",
    "Data Source": "data_source_name",
    "Structured": "structured_availability",
    "Unstructured": "unstructured_availability",
    "Country-Level": "country_level_availability",
    "Sub-Industry Availability": "sub_industry_availability",
    "Volume of Data": "volume_of_data",
    "Alternative Proxy Feasibility": "alternative_proxy_feasibility",
    "GenAI / ML Fillability": "genai_ml_fillability",
    "Industry-Level Variability": "industry_level_variability",
    "Longitudinal Availability": "longitudinal_availability",
    "Data Verification & Bias Risk": "data_verification_bias_risk",
    "Interdependence with Other Metrics": "interdependence_with_other_metrics",
    "Overlap with Other Metrics": "overlap_with_other_metrics",
    "Scoring Methodology Notes": "scoring_methodology_notes",
    "Readiness Status": "readiness_status",
    "Linked Sheet or Tab": "linked_sheet_or_tab",
}

# Fields of a metric sheet holding whole numbers.
METRIC_SHEET_INTEGERS = [
    "structured_availability",
    "unstructured_availability",
    "country_level_availability",
    "sub_industry_availability",
    "volume_of_data",
    "alternative_proxy_feasibility",
    "genai_ml_fillability",
    "industry_level_variability",
    "longitudinal_availability",
    "data_verification_bias_risk",
    "interdependence_with_other_metrics",
]

# Extra columns of two sheets.
SPECIAL_COLUMNS = {
    "4 Emissions Score": [
        "CO₂e_tonnes",
        "Output_or_GlobalTotal_or_Coverage_pct",
        "Employees",
        "Value_Added_USD",
    ],
    "20 Economic Score": ["Variable Data Fields"],
}

# Request parameters of the feeds.
IEA_DATASETS = ["COALINFO", "COALRESERVES", "COALPROD"]
WORLD_BANK_INDICATORS = ["EG.USE.COAL.KT.OE", "EN.ATM.CO2E.KT", "NY.GDP.MKTP.CD", "EG.ELC.COAL.ZS"]
TRADE_CODES = ["2701", "270111", "270112"]
IMF_INDICATORS = ["ENDA", "NGDP_RPCH", "PCPIPCH"]

# Health thresholds (warning, critical).
HEALTH_THRESHOLDS = {
    "cpu": (60.0, 80.0),
    "memory": (70.0, 85.0),
    "disk": (75.0, 90.0),
    "error_rate": (2.0, 5.0),
}

# Character class of blanks, Unicode ones included.
BLANK = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

BLANK_CHARACTERS = "".join(
    chr(c) for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)

# Namespace of path-derived document ids (RFC 4122, DNS).
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"

# Declared derived features with category and unit.
DERIVED_FEATURES = {
    "f_capacity_utilization_rate": ("operational", "ratio"),
    "f_revenue_per_mt": ("financial", "USD/MT"),
    "f_operating_margin": ("financial", "ratio"),
    "f_safety_incident_rate": ("safety", "incidents/1000_employees"),
    "f_carbon_intensity": ("environmental", "tCO2/MT"),
    "f_reserve_life_years": ("operational", "years"),
}

# Rational approximation of the standard normal law in double precision
# (Hart's coefficients, highest power first), for distances below 10 / sqrt(2).
NORMAL_NUMERATOR = [
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376,
]
NORMAL_DENOMINATOR = [
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
]
