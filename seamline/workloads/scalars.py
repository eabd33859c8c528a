"""Scalar functions, each applied to a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from seamline import fixed
from seamline.functions import dates, numeric
from seamline.functions import nested as nx
from seamline.functions import text as tx
from seamline.operators import relational as rel
from seamline.operators import vectors
from seamline.operators import windows as win
from seamline.plans import features
from seamline.workloads import standins as st
from seamline.workloads.registry import query
from seamline.workloads.sinks import N12_SQL, application_confidence

SLUG_SQL = "regexp_replace(replace(replace(lower({0}), ' ', '_'), '-', '_'), '[^a-z_]', '', 'g')"
SHEET_SQL = "CASE sheet_name " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.SHEET_NUMBERS.items()) + " ELSE '00' END"
KEY_SQL = f"concat({SHEET_SQL}, '_', {SLUG_SQL.format('raw_slug')})"
KEY = tx.metric_key


# --- strings --------------------------------------------------------------------

@query("f01_slugs", f"""
SELECT definition_id, {SLUG_SQL.format('raw_slug')} AS slug, {SLUG_SQL.replace('a-z_', 'a-z0-9_').format('raw_slug')} AS slug_with_digits
FROM metric_definitions
""")
def slugs(spark, sf):
    raw = F.col("raw_slug")
    return st.metric_definitions(spark, sf).select(
        "definition_id", tx.slug(raw).alias("slug"), tx.slug(raw, keep_digits=True).alias("slug_with_digits")
    )


@query("f02_composed_names", f"""
SELECT definition_id, {KEY_SQL} AS metric_key, concat('f_', {KEY_SQL}) AS feature_column, concat('w_', {KEY_SQL}, '_H10') AS weight_column,
  concat('raw_', {SLUG_SQL.format('sheet_name')}, '_', {SLUG_SQL.format('title')}) AS dataset_table FROM metric_definitions
""")
def composed_names(spark, sf):
    key = tx.metric_key(F.col("sheet_name"), F.col("raw_slug"))
    return st.metric_definitions(spark, sf).select(
        "definition_id", key.alias("metric_key"), tx.feature_name(key).alias("feature_column"),
        tx.weight_name(key, F.lit("H10")).alias("weight_column"),
        tx.dataset_name(F.col("sheet_name"), F.col("title")).alias("dataset_table"),
    )


NAMES_SQL = f"""names AS (SELECT definition_id, {KEY_SQL} AS good_key, concat('w_', {KEY_SQL}, '_H10') AS weight_column, raw_slug AS raw_name,
  concat('f_', {KEY_SQL}, CASE WHEN structured_availability = 1 THEN '9' ELSE '' END) AS feature_column,
  concat('s_', {SLUG_SQL.format('title')}, '_H20') AS score_column, concat('raw_', {SLUG_SQL.format('title')}, '_x') AS dataset FROM metric_definitions)"""


def _names(spark, sf):
    key = tx.metric_key(F.col("sheet_name"), F.col("raw_slug"))
    return st.metric_definitions(spark, sf).select(
        "definition_id", key.alias("good_key"), tx.weight_name(key, F.lit("H10")).alias("weight_column"),
        F.col("raw_slug").alias("raw_name"),
        F.concat(tx.feature_name(key), F.when(F.col("structured_availability") == 1, "9").otherwise("")).alias("feature_column"),
        tx.score_name(F.col("title"), F.lit("H20")).alias("score_column"),
        F.concat(F.lit("raw_"), tx.slug(F.col("title")), F.lit("_x")).alias("dataset"),
    )


P = fixed.NAME_PATTERNS


@query("f03_validated_names", f"""WITH {NAMES_SQL}
SELECT definition_id, regexp_matches(good_key, '{P['metric_key']}') AS metric_key, regexp_matches(raw_name, '{P['metric_key']}') AS raw_key,
  regexp_matches(dataset, '{P['dataset_table']}') AS dataset_table, regexp_matches(feature_column, '{P['feature_column']}') AS feature_column,
  regexp_matches(weight_column, '{P['weight_column']}') AS weight_column, regexp_matches(score_column, '{P['composite_score']}') AS composite_score
FROM names
""")
def validated_names(spark, sf):
    return _names(spark, sf).select(
        "definition_id",
        tx.is_valid_name(F.col("good_key"), "metric_key").alias("metric_key"),
        tx.is_valid_name(F.col("raw_name"), "metric_key").alias("raw_key"),
        tx.is_valid_name(F.col("dataset"), "dataset_table").alias("dataset_table"),
        tx.is_valid_name(F.col("feature_column"), "feature_column").alias("feature_column"),
        tx.is_valid_name(F.col("weight_column"), "weight_column").alias("weight_column"),
        tx.is_valid_name(F.col("score_column"), "composite_score").alias("composite_score"),
    )


@query("f04_parsed_names", f"""WITH {NAMES_SQL}
SELECT definition_id, nullif(regexp_extract(weight_column, '{P['weight_column']}', 1), '') AS sheet_number,
  nullif(regexp_extract(weight_column, '{P['weight_column']}', 2), '') AS slug, nullif(regexp_extract(weight_column, '{P['weight_column']}', 3), '') AS horizon,
  nullif(regexp_extract(score_column, '{P['composite_score']}', 1), '') AS sub_industry,
  nullif(regexp_extract(raw_name, '{P['metric_key']}', 2), '') AS raw_part FROM names
""")
def parsed_names(spark, sf):
    weight = tx.parse_name(F.col("weight_column"), "weight_column", ["sheet_number", "slug", "horizon"])
    score = tx.parse_name(F.col("score_column"), "composite_score", ["sub_industry", "horizon"])
    raw = tx.parse_name(F.col("raw_name"), "metric_key", ["sheet_number", "slug"])
    return _names(spark, sf).select(
        "definition_id", *[weight[c].alias(c) for c in ("sheet_number", "slug", "horizon")],
        score["sub_industry"].alias("sub_industry"), raw["slug"].alias("raw_part"),
    )


@query("f05_safe_numbers", """
SELECT event_id, CASE WHEN event_type IN ('view', 'error') THEN NULL ELSE value END AS as_double,
  CASE WHEN event_type IN ('view', 'error', 'purchase') THEN -1 ELSE user_id END AS as_int FROM events
""")
def safe_numbers(spark, sf):
    """Bracketed notes, blanks, words and decimals in whole-number cells."""
    kind = F.col("event_type")
    value, user = F.col("value").cast("string"), F.col("user_id").cast("string")
    cell = (
        F.when(kind == "view", " (not known) ").when(kind == "error", "about ten")
        .when(kind == "click", F.concat(value, F.lit(" (estimate)"))).otherwise(F.concat(F.lit(" "), value))
    )
    whole = (
        F.when(kind == "view", "").when(kind == "error", "n/a").when(kind == "purchase", F.concat(user, F.lit(".5")))
        .otherwise(F.concat(user, F.lit(" (people)")))
    )
    return st.table(spark, sf, "events").select(
        "event_id", tx.safe_number(cell, "double").alias("as_double"), tx.safe_number(whole, "bigint", -1).alias("as_int")
    )


@query("f06_flags", """
SELECT source_id, lower(api_available) IN ('true', 'yes', '1', 'y') AS flag FROM data_sources
""")
def flags(spark, sf):
    return st.data_sources(spark, sf).select("source_id", tx.flag_from_text(F.col("api_available")).alias("flag"))


@query("f07_clean_text", "SELECT doc_id, clean FROM clean_documents")
def clean_text(spark, sf):
    return st.documents(spark, sf).select("doc_id", tx.clean_lines(F.col("text")).alias("clean"))


HEADING_SQL = r"(length({0}) < 100 AND ((lower({0}) <> upper({0}) AND upper({0}) = {0}) OR (regexp_matches({0}, '^\p{{Nd}}') AND contains(left({0}, 10), '.'))))"
MARKDOWN_SQL = f"""
paged AS (SELECT doc_id, source, concat('--- Page 1 ---', chr(10), clean, chr(10), '--- Table 1 on Page 1 ---', chr(10), 'TOTAL ', doc_id, chr(10), 'last line') AS body FROM clean_documents),
cut AS (SELECT doc_id, source, string_split(body, chr(10)) AS ls FROM paged),
marked AS (SELECT doc_id, concat('# Document', chr(10), chr(10), '**Source:** ', source, chr(10), '**Pages:** 1', chr(10), chr(10), '---', chr(10), chr(10),
  array_to_string(list_transform(ls, lambda x, i: CASE
    WHEN starts_with(x, '--- Page') THEN concat('## ', trim(x, ' -'), chr(10), chr(10))
    WHEN starts_with(x, '--- Table') THEN concat('### ', trim(x, ' -'), chr(10), chr(10))
    WHEN {HEADING_SQL.format('x')} THEN concat('### ', x, chr(10), chr(10))
    WHEN i = len(ls) OR starts_with(ls[i + 1], '--- Page') OR starts_with(ls[i + 1], '--- Table') OR {HEADING_SQL.format('ls[i + 1]')} THEN concat(x, chr(10), chr(10))
    ELSE concat(x, chr(10)) END), '')) AS markdown FROM cut)"""


@query("f08_markdown", f"WITH {MARKDOWN_SQL.strip()} SELECT doc_id, markdown FROM marked")
def markdown(spark, sf):
    body = F.concat(
        F.lit("--- Page 1 ---\n"), tx.clean_lines(F.col("text")), F.lit("\n--- Table 1 on Page 1 ---\nTOTAL "),
        F.col("doc_id").cast("string"), F.lit("\nlast line"),
    )
    rendered = tx.markdown(F.col("body"), F.lit(None).cast("string"), F.col("source"), F.lit(1))
    return st.documents(spark, sf).withColumn("body", body).select("doc_id", rendered.alias("markdown"))


@query("f09_table_rows", """
SELECT definition_id, concat(definition_id, ' | ', title, ' | ', coalesce(readiness_status, ''), ' | ', coalesce(CAST(volume_of_data AS VARCHAR), '')) AS line
FROM metric_definitions
""")
def table_rows(spark, sf):
    cells = [F.col(c) for c in ("definition_id", "title", "readiness_status", "volume_of_data")]
    return st.metric_definitions(spark, sf).select("definition_id", tx.table_row(*cells).alias("line"))


REFERENCES_SQL = " UNION ALL ".join(
    f"SELECT definition_id, '{k}' AS type, regexp_extract_all(details, '(?i){p}', {1 if '(' in p else 0}) AS vals FROM reference_notes"
    for k, p in fixed.REFERENCE_PATTERNS.items()
)


@query("f10_text_references", f"SELECT definition_id, type, array_to_string(vals, '|') AS extracted FROM ({REFERENCES_SQL}) WHERE len(vals) > 0")
def text_references(spark, sf):
    found = st.reference_notes(spark, sf).select("definition_id", F.inline(tx.references(F.col("details"))))
    return found.select("definition_id", "type", F.array_join("values", "|").alias("extracted"))


INTENT_SQL = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(message), '{w}')" for w in words) + f" THEN '{name}'"
    for name, words in fixed.INTENT_KEYWORDS.items()
) + " ELSE 'general' END"


@query("f11_message_intent", f"SELECT conv_id, turn, {INTENT_SQL} AS intent FROM chat_prompts")
def message_intent(spark, sf):
    return st.chat_prompts(spark, sf).select("conv_id", "turn", tx.intent(F.col("message")).alias("intent"))


TOPIC_SQL = "array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN contains(lower(message), '{k}') THEN '{t}' END" for k, t in fixed.TOPIC_KEYWORDS.items()
) + "], lambda x: x IS NOT NULL), ', ')"


@query("f12_message_topics", f"SELECT conv_id, turn, {TOPIC_SQL} AS topics FROM chat_prompts WHERE role = 'user'")
def message_topics(spark, sf):
    users = st.chat_prompts(spark, sf).where("role = 'user'")
    return users.select("conv_id", "turn", F.array_join(tx.topics(F.col("message")), ", ").alias("topics"))


@query("f13_previews", """
SELECT doc_id, CASE WHEN length(text) > 200 THEN concat(substring(text, 1, 200), '...') ELSE text END AS preview,
  substring(source, 1, 8) AS short_source FROM documents
""")
def previews(spark, sf):
    return st.documents(spark, sf).select(
        "doc_id", tx.preview(F.col("text")).alias("preview"), F.substring("source", 1, 8).alias("short_source")
    )


@query("f14_title_case", """
SELECT definition_id, array_to_string(list_transform(string_split(replace(lower(title), '_', ' '), ' '),
  lambda x: concat(upper(x[1:1]), x[2:])), ' ') AS label FROM metric_definitions
""")
def title_case(spark, sf):
    slug = F.regexp_replace(F.lower("title"), " ", "_")
    return st.metric_definitions(spark, sf).select("definition_id", tx.title_case(slug).alias("label"))


FUNCTION_LIST = ", ".join(f"'{f}'" for f in fixed.FORMULA_FUNCTIONS)


@query("f15_formula_variables", f"""
WITH t AS (SELECT definition_id, concat('100 * log1p(', replace(title, ' ', ' / '), ') + max(Year_', volume_of_data, ', x1)') AS formula FROM metric_definitions)
SELECT definition_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(formula, '\\b([A-Za-z_][A-Za-z0-9_]*)\\b', 1)),
  lambda x: x NOT IN ({FUNCTION_LIST}))), ',') AS variables FROM t
""")
def formula_variables(spark, sf):
    formula = F.concat(
        F.lit("100 * log1p("), F.replace(F.col("title"), F.lit(" "), F.lit(" / ")), F.lit(") + max(Year_"),
        F.coalesce(F.col("volume_of_data").cast("string"), F.lit("")), F.lit(", x1)"),
    )
    return st.metric_definitions(spark, sf).select(
        "definition_id", F.array_join(tx.formula_variables(formula), ",").alias("variables")
    )


ANSWERS_SQL = "answers AS (SELECT conv_id, turn, concat(text, repeat(' [Source: a]', CAST(turn % 4 AS INTEGER))) AS answer FROM conversations WHERE role = 'assistant')"


def _answers(spark, sf):
    msgs = st.table(spark, sf, "conversations").where("role = 'assistant'")
    return msgs.select("conv_id", "turn", F.concat("text", F.repeat(F.lit(" [Source: a]"), (F.col("turn") % 4).cast("int"))).alias("answer"))


@query("f16_citation_counts", f"""WITH {ANSWERS_SQL}
SELECT conv_id, turn, CAST((length(answer) - length(replace(answer, '[Source:', ''))) // 8 AS BIGINT) AS citations,
  (length(answer) - length(replace(answer, '[Source:', ''))) // 8 >= 2 AS valid FROM answers
""")
def citation_counts(spark, sf):
    n = tx.citation_count(F.col("answer"))
    return _answers(spark, sf).select("conv_id", "turn", n.alias("citations"), (n >= 2).alias("valid"))


PREFIX_SQL = "CASE " + " ".join(f"WHEN starts_with(short, '{k}') THEN '{v}'" for k, v in fixed.SCORE_NAME_BY_PREFIX.items()) + " ELSE short END"


@query("f17_score_labels", f"""
SELECT definition_id, {PREFIX_SQL} AS label FROM (SELECT definition_id, substring(sheet_name, 1, 31) AS short FROM metric_definitions)
""")
def score_labels(spark, sf):
    """Sheet names cut at 31 characters, as a workbook shows them."""
    return st.metric_definitions(spark, sf).select(
        "definition_id", tx.score_label(F.substring("sheet_name", 1, 31)).alias("label")
    )


# --- numbers --------------------------------------------------------------------

@query("n01_formula_functions", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(ln(1 + l_quantity), 6) AS a, round(exp(l_discount), 6) AS b, round(ln(l_extendedprice), 6) AS c,
  round(sqrt(l_quantity), 6) AS d, round(abs(l_tax - 0.05), 6) AS e, round(1 / (1 + exp(-l_tax)), 6) AS f,
  round((l_tax + l_discount) / 2, 6) AS g, greatest(l_tax, l_discount) AS h, least(l_tax, l_discount) AS i FROM lineitem
""")
def formula_functions(spark, sf):
    from seamline.plans import formulas

    cells = {
        "a": "log1p(l_quantity)", "b": "exp(l_discount)", "c": "log(l_extendedprice)", "d": "sqrt(l_quantity)",
        "e": "abs(l_tax - 0.05)", "f": "sigmoid(l_tax)", "g": "avg(l_tax, l_discount)", "h": "max(l_tax, l_discount)",
        "i": "min(l_tax, l_discount)",
    }
    frame = st.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_extendedprice", "l_tax")
    return formulas.with_formulas(frame, cells).select("l_orderkey", "l_linenumber", *cells)


@query("n02_guarded_division", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(l_tax / nullif(l_discount, 0), 6) AS ratio FROM lineitem")
def guarded_division(spark, sf):
    ratio = numeric.divide(F.col("l_tax"), F.col("l_discount"))
    return st.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", ratio.alias("ratio"))


@query("n03_min_max_scale", """
SELECT event_id, round((value - (SELECT min(value) FROM gappy)) / (SELECT max(value) - min(value) FROM gappy) * 100, 6) AS scaled,
  CASE WHEN value IS NOT NULL THEN 50.0::DOUBLE END AS flat FROM gappy
""")
def min_max_scale(spark, sf):
    frame = st.gappy(spark, sf).withColumn("one", F.col("value") * 0 + 1)
    return win.normalise(win.normalise(frame, "value", "min_max", "scaled"), "one", "min_max", "flat").select("event_id", "scaled", "flat")


@query("n04_z_scale", """
WITH s AS (SELECT user_id, avg(value) AS m, stddev_pop(value) AS d FROM gappy GROUP BY user_id)
SELECT event_id, g.user_id, CASE WHEN value IS NULL THEN NULL WHEN d = 0 THEN 50
  ELSE round(greatest(0, least(100, ((value - m) / d + 3) / 6 * 100)), 6) END AS scaled FROM gappy g JOIN s ON g.user_id = s.user_id
""")
def z_scale(spark, sf):
    return win.normalise(st.gappy(spark, sf), "value", "z_score", "scaled", keys=["user_id"]).select("event_id", "user_id", "scaled")


@query("n05_sorted_curve", """
WITH r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS n FROM events),
v AS (SELECT value, row_number() OVER (ORDER BY value) AS n FROM events)
SELECT event_id, value AS curve FROM r JOIN v ON r.n = v.n
""")
def sorted_curve(spark, sf):
    return win.sorted_curve(st.table(spark, sf, "events").select("event_id", "value"), ["event_id"], "value", "curve").select("event_id", "curve")


@query("n06_missing_value_fills", """
SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM gappy)), 6) AS by_mean,
  round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM gappy)), 6) AS by_median, coalesce(value, 0) AS by_zero FROM gappy
""")
def missing_value_fills(spark, sf):
    frame = st.gappy(spark, sf)
    for method in ("mean", "median", "zero"):
        frame = win.fill_missing(frame, "value", method, f"by_{method}")
    return frame.select("event_id", "by_mean", "by_median", "by_zero")


@query("n07_iqr_outliers", """
WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
SELECT event_id, value FROM events, q WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)
""")
def iqr_outliers(spark, sf):
    return win.outliers(st.table(spark, sf, "events").select("event_id", "value"), "value", "iqr")


@query("n08_z_outliers", """
SELECT event_id, value FROM events WHERE abs((value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events)) > 3
""")
def z_outliers(spark, sf):
    return win.outliers(st.table(spark, sf, "events").select("event_id", "value"), "value", "z_score")


@query("n09_modified_z_outliers", """
WITH m AS (SELECT quantile_cont(value, 0.5) AS med FROM events), d AS (SELECT quantile_cont(abs(value - med), 0.5) AS mad FROM events, m)
SELECT event_id, value FROM events, m, d WHERE CASE WHEN mad = 0 THEN value <> med ELSE abs(0.6745 * (value - med) / mad) > 3.5 END
""")
def modified_z_outliers(spark, sf):
    return win.outliers(st.table(spark, sf, "events").select("event_id", "value"), "value", "modified_z_score")


N10_SQL = """(coalesce(structured_availability, 0) + coalesce(country_level_availability, 0) + coalesce(sub_industry_availability, 0)
  + coalesce(volume_of_data, 0) + coalesce(genai_ml_fillability, 0)) / 5.0"""
N11_SQL = """(coalesce(structured_availability, 0) + coalesce(country_level_availability, 0) + coalesce(sub_industry_availability, 0)
  + coalesce(volume_of_data, 0) + coalesce(genai_ml_fillability, 0) + coalesce(longitudinal_availability, 0)
  + coalesce(6 - data_verification_bias_risk, 0) + coalesce(6 - interdependence_with_other_metrics, 0)) / 8.0"""
SEED = ("structured_availability", "country_level_availability", "sub_industry_availability", "volume_of_data", "genai_ml_fillability")
TRIGGER = (*SEED, "longitudinal_availability", "data_verification_bias_risk", "interdependence_with_other_metrics")


@query("n10_confidence_seed", f"SELECT definition_id, round({N10_SQL}, 6) AS confidence FROM metric_definitions")
def confidence_seed(spark, sf):
    return st.metric_definitions(spark, sf).select("definition_id", numeric.confidence_seed(*map(F.col, SEED)).alias("confidence"))


@query("n11_confidence_trigger", f"SELECT definition_id, round({N11_SQL}, 6) AS confidence FROM metric_definitions")
def confidence_trigger(spark, sf):
    return st.metric_definitions(spark, sf).select("definition_id", numeric.confidence_trigger(*map(F.col, TRIGGER)).alias("confidence"))


@query("n12_confidence_application", f"SELECT definition_id, round({N12_SQL}, 6) AS confidence FROM metric_definitions")
def confidence_application(spark, sf):
    return st.metric_definitions(spark, sf).select("definition_id", application_confidence().alias("confidence"))


@query("n13_quality_score", """
SELECT mine_id, feature_date, round(0.4 * feature_freshness_score + 0.3 * least(1.0, n_events / 10.0) + 0.3 * (incidents / n_events), 6) AS quality,
  round(0.8 * (0.4 * feature_freshness_score + 0.3 * least(1.0, n_events / 10.0) + 0.3 * (incidents / n_events)), 6) AS adjusted FROM gold_features
""")
def quality_score(spark, sf):
    q = numeric.quality_score(
        F.col("feature_freshness_score"), F.least(F.lit(1.0), F.col("n_events") / 10.0), F.col("incidents") / F.col("n_events")
    )
    return st.gold_features(spark, sf).select("mine_id", "feature_date", q.alias("quality"), (0.8 * q).alias("adjusted"))


@query("n14_clamped", "SELECT score_id, round(greatest(10, least(60, score)), 6) AS clamped FROM composite_scores")
def clamped(spark, sf):
    return st.composite_scores(spark, sf).select("score_id", numeric.clamp(F.col("score"), 10, 60).alias("clamped"))


@query("n15_percent_change", """
WITH p AS (SELECT mine_id, feature_date, revenue AS old, operating_cost AS new,
  coalesce((operating_cost - revenue) / nullif(revenue, 0) * 100, 0) AS pct FROM gold_features)
SELECT mine_id, feature_date, round(pct, 6) AS percent, CASE WHEN abs(pct) > 5 THEN 'significant' WHEN abs(pct) > 2 THEN 'moderate' ELSE 'minor' END AS magnitude FROM p
""")
def percent_change(spark, sf):
    percent = numeric.percent_change(F.col("revenue"), F.col("operating_cost"))
    return st.gold_features(spark, sf).select(
        "mine_id", "feature_date", percent.alias("percent"), numeric.change_magnitude(percent).alias("magnitude")
    )


@query("n16_score_band", """
SELECT score_id, CASE WHEN score > 60 THEN 'high' WHEN score > 40 THEN 'moderate' ELSE 'low' END AS band FROM composite_scores
""")
def score_band(spark, sf):
    return st.composite_scores(spark, sf).select("score_id", numeric.score_band(F.col("score")).alias("band"))


@query("n17_normal_interval", """
SELECT sub_industry, country, round(avg(score) - 1.959963984540054 * stddev_pop(score), 6) AS lower,
  round(avg(score) + 1.959963984540054 * stddev_pop(score), 6) AS upper FROM composite_scores GROUP BY 1, 2
""")
def normal_interval(spark, sf):
    groups = st.composite_scores(spark, sf).groupBy("sub_industry", "country").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s"))
    return groups.select("sub_industry", "country", numeric.normal_interval(F.col("m"), F.col("s"), 0.95).alias("i")).select(
        "sub_industry", "country", "i.lower", "i.upper"
    )


def _polynomial_sql(terms, x):
    """Sum of the terms times falling powers of ``x``."""
    return " + ".join(f"{term!r}::DOUBLE * power({x}, {len(terms) - 1 - k})" for k, term in enumerate(terms))


@query("n18_probability_of_improvement", f"""
WITH g AS (SELECT sub_industry, country, avg(score) - (SELECT avg(score) FROM composite_scores) AS m, stddev_samp(score) / sqrt(count(*)) AS s FROM composite_scores GROUP BY 1, 2),
z AS (SELECT sub_industry, country, m / nullif(s, 0) AS z, abs(m / nullif(s, 0)) AS a FROM g),
t AS (SELECT *, CASE WHEN a < 7 THEN exp(-a * a / 2) * ({_polynomial_sql(fixed.NORMAL_NUMERATOR, 'a')}) / ({_polynomial_sql(fixed.NORMAL_DENOMINATOR, 'a')}) WHEN a >= 7 THEN 0 END AS tail FROM z)
SELECT sub_industry, country, round(CASE WHEN z > 0 THEN 1 - tail ELSE tail END, 6) AS probability FROM t
""")
def probability_of_improvement(spark, sf):
    """Chance that a group scores above the overall mean."""
    scores = st.composite_scores(spark, sf)
    grand = scores.agg(F.avg("score")).scalar()
    groups = scores.groupBy("sub_industry", "country").agg(
        F.avg("score").alias("m"), (F.stddev_samp("score") / F.sqrt(F.count("*"))).alias("s")
    )
    return groups.select("sub_industry", "country", numeric.probability_positive(F.col("m") - grand, F.col("s")).alias("probability"))


@query("n19_response_confidence", f"""WITH {ANSWERS_SQL}, c AS (SELECT *, (length(answer) - length(replace(answer, '[Source:', ''))) // 8 AS n FROM answers)
SELECT conv_id, turn, round((CASE WHEN n >= 2 THEN 0.8 ELSE 0.4 END + CASE WHEN turn % 3 = 0 THEN 0.2 ELSE 0.5 END
  + CASE WHEN length(answer) BETWEEN 200 AND 2000 THEN 0.8 ELSE 0.6 END) / 3, 6) AS confidence FROM c
""")
def response_confidence(spark, sf):
    similarity = F.when(F.col("turn") % 3 != 0, 0.5)
    confidence = numeric.response_confidence(tx.citation_count(F.col("answer")), similarity, F.length("answer"))
    return _answers(spark, sf).select("conv_id", "turn", confidence.alias("confidence"))


HEALTH_SQL = "CASE metric " + " ".join(f"WHEN '{m}' THEN {{{i}}}" for i, m in enumerate(fixed.HEALTH_THRESHOLDS)) + " END"


def _health_sql(which):
    return HEALTH_SQL.format(*[t[which] for t in fixed.HEALTH_THRESHOLDS.values()])


@query("n20_health_bands", f"""
WITH m AS (SELECT mine_id, avg(feature_freshness_score) * 100 AS cpu, 100 * sum(revenue) / sum(production_mt) AS memory,
   100 * sum(production_mt) / sum(capacity_mt) AS disk, 10.0 * sum(incidents) / sum(n_events) AS error_rate FROM gold_features GROUP BY 1),
l AS (SELECT mine_id, 'cpu' AS metric, cpu AS value FROM m UNION ALL SELECT mine_id, 'memory', memory FROM m
  UNION ALL SELECT mine_id, 'disk', disk FROM m UNION ALL SELECT mine_id, 'error_rate', error_rate FROM m),
t AS (SELECT *, {_health_sql(0)} AS moderate, {_health_sql(1)} AS high FROM l)
SELECT mine_id, metric, CASE WHEN value >= high THEN 'red' WHEN value >= high * 0.8 THEN 'yellow' ELSE 'green' END AS colour,
  CASE WHEN value >= high THEN 'High' WHEN value >= moderate THEN 'Moderate' ELSE 'Low' END AS level FROM t
""")
def health_bands(spark, sf):
    total = lambda c: F.sum(c)
    wide = st.gold_features(spark, sf).groupBy("mine_id").agg(
        (F.avg("feature_freshness_score") * 100).alias("cpu"),
        (100 * total("revenue") / total("production_mt")).alias("memory"),
        (100 * total("production_mt") / total("capacity_mt")).alias("disk"),
        (10.0 * total("incidents") / total("n_events")).alias("error_rate"),
    )
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in fixed.HEALTH_THRESHOLDS])
    long = wide.select("mine_id", F.inline(pairs))
    moderate, high = (
        F.element_at(tx.lit_map({m: t[i] for m, t in fixed.HEALTH_THRESHOLDS.items()}), F.col("metric")) for i in (0, 1)
    )
    return long.select(
        "mine_id", "metric", numeric.health_colour(F.col("value"), high).alias("colour"),
        numeric.health_level(F.col("value"), moderate, high).alias("level"),
    )


# --- dates ----------------------------------------------------------------------

@query("d01_lenient_timestamps", """
SELECT event_id, CASE WHEN event_type = 'view' THEN NULL WHEN event_type = 'click' THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) ELSE ts END AS parsed FROM events
""")
def lenient_timestamps(spark, sf):
    kind = F.col("event_type")
    text = (
        F.when(kind == "view", "2024-13-45").when(kind == "click", F.date_format("ts", "yyyy-MM-dd"))
        .otherwise(F.col("ts").cast("string"))
    )
    return st.table(spark, sf, "events").select("event_id", dates.lenient_timestamp(text).alias("parsed"))


@query("d02_calendar_parts", """
SELECT o_orderkey, year(o_orderdate)::BIGINT AS metric_year, quarter(o_orderdate)::BIGINT AS metric_quarter, month(o_orderdate)::BIGINT AS metric_month FROM orders
""")
def calendar_parts(spark, sf):
    return st.table(spark, sf, "orders").select("o_orderkey", *dates.calendar_parts(F.col("o_orderdate")))


@query("d03_iso_rendering", """
SELECT event_id, CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS iso FROM events
""")
def iso_rendering(spark, sf):
    return st.table(spark, sf, "events").select("event_id", dates.iso_8601(F.col("ts")).alias("iso"))


@query("d04_training_schedule", """
SELECT o_orderkey, isodow(o_orderdate) = 1 AS trains, CASE o_orderstatus WHEN 'F' THEN 30 WHEN 'O' THEN 90 ELSE 365 END::BIGINT AS lookback_days,
  o_orderdate - to_days(CASE o_orderstatus WHEN 'F' THEN 30 WHEN 'O' THEN 90 ELSE 365 END) AS since FROM orders
""")
def training_schedule(spark, sf):
    schedule = F.when(F.col("o_orderstatus") == "F", "daily").when(F.col("o_orderstatus") == "O", "weekly").otherwise("monthly")
    days = F.element_at(tx.lit_map(dates.LOOKBACK_DAYS), schedule)
    return st.table(spark, sf, "orders").select(
        "o_orderkey", dates.is_training_day(F.col("o_orderdate")).alias("trains"), days.alias("lookback_days"),
        (F.col("o_orderdate") - F.make_dt_interval(days)).alias("since"),
    )


@query("d05_data_lag", """
SELECT user_id, round((epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(ts))) / 3600000000.0, 6) AS lag_hours,
  (epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(ts))) / 3600000000.0 <= 24 AS fresh FROM events GROUP BY user_id
""")
def data_lag(spark, sf):
    events = st.table(spark, sf, "events")
    lag = dates.lag_hours(F.col("latest"), rel.latest_value(events, "ts"))
    return events.groupBy("user_id").agg(F.max("ts").alias("latest")).select("user_id", lag.alias("lag_hours"), (lag <= 24).alias("fresh"))


# --- arrays, maps, JSON, hashes -------------------------------------------------

@query("h01_feed_provenance", """
SELECT event_id, sha256(concat('{"event_type": "', event_type, '", "id": "', event_id, '", "props": "', replace(props, '"', '\\"'), '"}'))[1:16] AS provenance_hash FROM events
""")
def feed_provenance(spark, sf):
    payload = nx.canonical_json({"id": F.col("event_id").cast("string"), "event_type": F.col("event_type"), "props": F.col("props")})
    return st.table(spark, sf, "events").select("event_id", nx.feed_hash(payload).alias("provenance_hash"))


@query("h02_chunk_provenance", """
SELECT doc_id, sha256(concat(text, '{"lang": "', lang, '", "source": "', source, '"}')) AS provenance_hash FROM documents
""")
def chunk_provenance(spark, sf):
    metadata = nx.canonical_json({"source": F.col("source"), "lang": F.col("lang")})
    return st.documents(spark, sf).select("doc_id", nx.chunk_hash(F.col("text"), metadata).alias("provenance_hash"))


@query("h03_content_hash", """
SELECT s_suppkey, md5(concat('{"name": "', s_name, '", "nation": "', s_nationkey, '"}')) AS content_hash FROM supplier
""")
def content_hash(spark, sf):
    fields = {"name": F.col("s_name"), "nation": F.col("s_nationkey").cast("string"), "updated_at": F.lit("now")}
    return st.table(spark, sf, "supplier").select("s_suppkey", nx.content_hash(fields).alias("content_hash"))


@query("h04_path_ids", f"""
WITH h AS (SELECT page_id, sha1(unhex('{fixed.DNS_NAMESPACE}') || encode(url)) AS d FROM pages)
SELECT page_id, concat(d[1:8], '-', d[9:12], '-5', d[14:16], '-', substr('89ab', (instr('0123456789abcdef', d[17:17]) - 1) % 4 + 1, 1), d[18:20], '-', d[21:32]) AS document_id FROM h
""")
def path_ids(spark, sf):
    return st.table(spark, sf, "pages").select("page_id", nx.path_uuid(F.col("url")).alias("document_id"))


@query("h05_chunk_ids", "SELECT conv_id, turn, concat('c', conv_id, '_', lpad(CAST(turn AS VARCHAR), 4, '0')) AS chunk_id FROM conversations")
def chunk_ids(spark, sf):
    document = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    return st.table(spark, sf, "conversations").select("conv_id", "turn", nx.chunk_id(document, F.col("turn")).alias("chunk_id"))


@query("h06_hash_codes", """
SELECT c_custkey, CAST(concat('0x', md5(c_mktsegment)[1:8]) AS BIGINT) % 1000 / 1000.0 AS code FROM customer
""")
def hash_codes(spark, sf):
    return st.table(spark, sf, "customer").select("c_custkey", nx.hash_code(F.col("c_mktsegment")).alias("code"))


@query("h07_wide_long_wide", """
SELECT entity_id, necessity_score, emissions_score, economic_score FROM entity_components
""")
def wide_long_wide(spark, sf):
    wanted = ["necessity_score", "emissions_score", "economic_score"]
    return nx.to_wide(nx.to_long(st.entity_components(spark, sf), ["entity_id"], wanted, "metric", "value"), ["entity_id"], wanted, "metric", "value")


@query("h08_parsed_metrics", """
SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) END AS k,
  CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END::BIGINT AS n_keys FROM events
""")
def parsed_metrics(spark, sf):
    text = F.when(F.col("event_type") == "error", "").otherwise(F.col("props"))
    parsed = st.table(spark, sf, "events").select("event_id", nx.parse_metrics(text).alias("m"))
    return parsed.select("event_id", F.try_element_at("m", F.lit("k")).alias("k"), F.size("m").alias("n_keys"))


@query("h09_cosine_similarity", """
SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT centre FROM centroid)), 6) AS similarity FROM embeddings
""")
def cosine_similarity(spark, sf):
    vecs = st.table(spark, sf, "embeddings")
    centre = vectors.overall_centre(vecs, "embedding")
    return vecs.select("vec_id", vectors.cosine_to(F.col("embedding"), centre).alias("similarity"))


@query("h10_euclidean_distance", """
SELECT vec_id, round(list_distance(CAST(embedding AS DOUBLE[]), (SELECT centre FROM centroid)), 6) AS distance FROM embeddings
""")
def euclidean_distance(spark, sf):
    vecs = st.table(spark, sf, "embeddings")
    centre = vectors.overall_centre(vecs, "embedding")
    return vecs.select("vec_id", vectors.l2_to(F.col("embedding"), centre).alias("distance"))


@query("h11_feature_vectors", """
SELECT mine_id, feature_date, production_mt AS v1, coalesce(esg_score, 0) AS v2, 0.0::DOUBLE AS v3 FROM gold_features
""")
def feature_vectors(spark, sf):
    bag = F.map_filter(F.create_map(F.lit("production"), F.col("production_mt"), F.lit("esg"), F.col("esg_score")), lambda k, v: v.isNotNull())
    vector = nx.feature_vector(bag, ["production", "esg", "absent"])
    return st.gold_features(spark, sf).select("mine_id", "feature_date", vector.alias("v")).select(
        "mine_id", "feature_date", *[F.get("v", F.lit(i)).alias(f"v{i + 1}") for i in range(3)]
    )


@query("h12_feature_types", """
SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'double' WHEN 1 THEN 'bigint' WHEN 2 THEN 'string' WHEN 3 THEN 'boolean' WHEN 4 THEN 'timestamp' ELSE 'double' END AS spark_type FROM part
""")
def feature_types(spark, sf):
    declared = ["Float", "int", "String", "bool", "timestamp", "decimal"]
    name = F.get(tx.lit_array(declared), F.col("p_size") % 6)
    return st.table(spark, sf, "part").select("p_partkey", nx.feature_type_column(name).alias("spark_type"))


@query("h13_arrays_to_rows", """
SELECT country, y AS year, CAST(sum(n) AS BIGINT) AS orders, CAST(sum(amount) AS BIGINT) AS amount FROM feed_points GROUP BY 1, 2
""")
def arrays_to_rows(spark, sf):
    """Parallel arrays per country (one entry per year) become one row per year."""
    orders = st.table(spark, sf, "orders").join(st.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(
        st.nations(spark, sf), F.col("c_nationkey") == F.col("n_nationkey"))
    yearly = orders.groupBy(F.col("n_name").alias("country"), F.year("o_orderdate").alias("year")).agg(
        F.count("*").alias("orders"), F.sum(F.floor("o_totalprice")).alias("amount"))
    packed = yearly.groupBy("country").agg(F.array_sort(F.collect_list(F.struct("year", "orders", "amount"))).alias("p"))
    arrays = packed.select("country", *[F.col("p").getField(f).alias(f) for f in ("year", "orders", "amount")])
    return arrays.select("country", F.inline(F.arrays_zip("year", "orders", "amount")))
