"""Data-quality reports and catalogue audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.functions import dates, numeric
from seamline.functions import text as tx
from seamline.operators import relational as rel

# Declared thresholds of a table.
COMPLETENESS, FRESHNESS_HOURS, UNIQUENESS = 0.95, 24.0, 0.99


def table_report(df: DataFrame, name: str, key: list[str], ts: str, as_of: Column) -> DataFrame:
    """Completeness, freshness and uniqueness of one table against thresholds.

    Rows are counted per key first, so distinct keys cost no second pass.
    """
    cells = [F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in df.columns]
    per_key = df.groupBy(*key).agg(
        F.count("*").alias("n"), F.sum(sum(cells[1:], cells[0])).alias("filled"), F.max(ts).alias("latest")
    )
    totals = per_key.agg(
        F.sum("n").alias("rows"), F.count("*").alias("keys"), F.sum("filled").alias("filled"), F.max("latest").alias("latest")
    )
    measured = totals.select(
        F.lit(name).alias("table_name"), "rows",
        F.try_divide(F.col("filled"), F.col("rows") * len(df.columns)).alias("completeness"),
        F.try_divide("keys", "rows").alias("uniqueness"),
        dates.lag_hours(F.col("latest"), as_of).alias("lag_hours"),
    )
    passed = {
        "complete": F.col("completeness") >= COMPLETENESS,
        "fresh": F.col("lag_hours") <= FRESHNESS_HOURS,
        "unique": F.col("uniqueness") >= UNIQUENESS,
    }
    score = numeric.row_mean(*[F.when(p, 1.0).otherwise(0.0) for p in passed.values()])
    return measured.withColumns(passed).withColumn("band", numeric.quality_band(score))


def catalogue_audit(definitions: DataFrame, key: Column, required: list[str]) -> DataFrame:
    """Name and required-field findings per definition."""
    missing = rel.missing_fields(**{c: F.col(c) for c in required})
    valid = tx.is_valid_name(key, "metric_key")
    return definitions.select(
        "definition_id", key.alias("metric_key"), valid.alias("name_ok"),
        F.array_join(missing, ",").alias("missing"), (valid & (F.size(missing) == 0)).alias("is_valid"),
    )
