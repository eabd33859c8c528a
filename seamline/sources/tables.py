"""Table scans: Parquet, named tables, JDBC, sheets, catalogue and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline import fixed
from seamline.functions import text as tx
from seamline.functions.numeric import nan_to_null
from seamline.operators.relational import with_frame_stats


def jdbc_scan(spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int, partitions: int, **options) -> DataFrame:
    """Parallel JDBC read split on a numeric column."""
    return spark.read.jdbc(
        url, table, column=column, lowerBound=lower, upperBound=upper, numPartitions=partitions, properties=options
    )


def by_stride(df: DataFrame, column: str, partitions: int) -> DataFrame:
    """Stride of the partition column each row belongs to, as a parallel scan splits it."""
    bounded = with_frame_stats(df, _lo=F.min(column), _hi=F.max(column))
    place = F.floor((F.col(column) - F.col("_lo")) * partitions / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1)))
    return bounded.withColumn("stride", F.least(place, F.lit(partitions - 1))).drop("_lo", "_hi")


def named_scan(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


CATALOGUE = """
struct<metric_key:string,feature_column:string,
  sheet_info:struct<sheet_name:string,sheet_number:string,thematic_focus:string>,
  basic_info:struct<title:string,slug:string,details:string,data_fields_required:string,formula:string,
    weighting_in_metric:double,data_source:string>,
  data_quality:struct<structured_availability:int,unstructured_availability:int,country_level_availability:int,
    sub_industry_availability:int,volume_of_data:int,alternative_proxy_feasibility:int,genai_ml_fillability:int,
    industry_level_variability:int,longitudinal_availability:int,data_verification_bias_risk:int,
    interdependence_with_other_metrics:int>,
  assessment:struct<overlap_with_other_metrics:string,scoring_methodology_notes:string,readiness_status:string,
    linked_sheet_or_tab:string>,
  weight_columns:struct<H5:string,H10:string,H20:string>>
"""


def catalogue_definitions(documents: DataFrame, json: str) -> DataFrame:
    """Flat metric definitions from nested catalogue entries."""
    entry = documents.withColumn("e", F.from_json(json, CATALOGUE.replace("\n", "")))
    rest = [c for c in documents.columns if c != json]
    return entry.select(
        *rest, "e.metric_key", "e.feature_column", "e.sheet_info.sheet_name", "e.sheet_info.sheet_number",
        "e.basic_info.title", "e.basic_info.weighting_in_metric", "e.data_quality.structured_availability",
        "e.assessment.readiness_status", F.col("e.weight_columns.H10").alias("weight_h10"),
    )


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Header-bearing sheet as text columns."""
    return spark.read.option("header", True).option("multiLine", False).csv(path)


def _renamed(sheet: DataFrame, fields: dict[str, str], casts: dict[str, Column]) -> list[Column]:
    present = {h: f for h, f in fields.items() if h in sheet.columns}
    return [casts.get(f, F.col(f"`{h}`")).alias(f) for h, f in present.items()]


def source_sheet(sheet: DataFrame) -> DataFrame:
    """Data-source rows: renamed, flags and lags typed, rows without a name dropped."""
    casts = {
        "api_available": tx.flag_from_text(F.col("API")) if "API" in sheet.columns else F.lit(None),
        "update_lag_days": F.col("`Update Lag_days`").try_cast("int") if "Update Lag_days" in sheet.columns else F.lit(None),
    }
    return sheet.select(*_renamed(sheet, fixed.SOURCE_SHEET_FIELDS, casts)).where("coalesce(name, '') <> ''")


def metric_sheet(sheet: DataFrame) -> DataFrame:
    """Metric rows: renamed, numbers typed, slug derived from the title when absent."""
    headers = {f: h for h, f in fixed.METRIC_SHEET_FIELDS.items()}
    casts = {f: F.col(f"`{headers[f]}`").try_cast("int") for f in fixed.METRIC_SHEET_INTEGERS if headers[f] in sheet.columns}
    if "Weighting In Metric" in sheet.columns:
        casts["weighting_in_metric"] = nan_to_null(F.col("`Weighting In Metric`").try_cast("double"))
    extra = [F.col("sheet_name")] if "sheet_name" in sheet.columns else []
    rows = sheet.select(*extra, *_renamed(sheet, fixed.METRIC_SHEET_FIELDS, casts)).where("coalesce(title, '') <> ''")
    slug = F.regexp_replace(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    given = F.nullif(F.col("metric_slug"), F.lit("")) if "metric_slug" in rows.columns else F.lit(None)
    return rows.withColumn("metric_slug", F.coalesce(given, slug))


def body_rows(sheet: DataFrame, metric: str, title: str) -> DataFrame:
    """Rows that are neither blank nor a repeated header."""
    blank = F.col(metric).isNull() & F.col(title).isNull()
    header = F.upper(F.coalesce(F.col(metric), F.lit(""))) == "METRIC"
    return sheet.where(~blank & ~header)


def special_columns(sheet: DataFrame, key: str, sheet_name: str) -> DataFrame:
    """Sheet-specific extra columns in long form: (sheet, column, row key, value).

    A list per column would put a whole sheet into one row; long form keeps
    every value and any sheet size.
    """
    present = [c for wanted in fixed.SPECIAL_COLUMNS.values() for c in wanted if c in sheet.columns]
    allowed = F.create_map(*[x for s, cs in fixed.SPECIAL_COLUMNS.items() for x in (F.lit(s), tx.lit_array(cs))])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in present])
    return (
        sheet.select(F.col(sheet_name).alias("sheet_name"), F.col(key).alias("row_key"), F.inline(pairs))
        .where(F.array_contains(F.try_element_at(allowed, F.col("sheet_name")), F.col("column_name")))
    )


def source_records(df: DataFrame, name: str, kind: str, api: str, metadata: list[str]) -> DataFrame:
    """Nested data-source records with defaults for type and flag."""
    def blank_to_null(c: str) -> Column:
        return F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))

    return df.where(F.col(name).isNotNull()).select(
        F.trim(name).alias("name"),
        F.coalesce(blank_to_null(kind), F.lit("External")).alias("source_type"),
        F.coalesce(tx.flag_from_text(F.col(api)), F.lit(False)).alias("api_available"),
        F.lit(True).alias("is_active"),
        F.struct(*[blank_to_null(c).alias(c) for c in metadata]).alias("metadata"),
    )


def document_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Documents found by a file pattern below a folder, with a status."""
    docs = spark.read.schema("doc_id bigint, text string, source string").option("recursiveFileLookup", True).option(
        "pathGlobFilter", pattern
    ).json(path)
    return docs.withColumn("status", F.when(F.trim(F.coalesce("text", F.lit(""))) != "", "processed").otherwise("failed"))


def crawled_fields(pages: DataFrame, html: str, patterns: dict[str, list[str]]) -> DataFrame:
    """Record fields of a page, the first non-empty candidate per field."""
    return pages.withColumns({f: tx.first_capture(F.col(html), ps) for f, ps in patterns.items()})


def payload_items(df: DataFrame, payload: str, item: str) -> DataFrame:
    """Items of a response that is a list, or an object holding ``mines``."""
    array_type = f"array<struct<{item}>>"
    as_list = F.when(F.col(payload).startswith("["), F.from_json(payload, array_type))
    as_object = F.from_json(payload, f"struct<mines:{array_type}>")["mines"]
    rest = [c for c in df.columns if c != payload]
    return df.select(*rest, F.inline(F.coalesce(as_list, as_object)))
