"""Layered refinement: raw responses to bronze, silver and gold tables.

Each stage takes DataFrames and returns DataFrames; the only points where data
is written are the layer tables themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline import fixed
from seamline.functions import text as tx
from seamline.operators import relational as rel
from seamline.operators import windows as win
from seamline.plans import formulas
from seamline.sources import feeds, sinks


def bronze(responses: DataFrame, source: str, ingested_at: Column, version: str) -> DataFrame:
    """Flattened records of one source with load metadata; error rows are left out."""
    records = feeds.uniform_records(responses, source).where("error IS NULL").drop("error")
    return records.select(
        "*", F.lit(source.lower()).alias("source_name"), ingested_at.alias("ingest_date"), F.lit(version).alias("data_version")
    )


def bronze_of_all(responses: DataFrame, ingested_at: Column, version: str, folder: str) -> DataFrame:
    """Records of all sources with load metadata, stored by source in one pass; error rows are left out."""
    records = feeds.routed(responses).where("error IS NULL").drop("error")
    stamped = records.select("*", F.lower("source").alias("source_name"), ingested_at.alias("ingest_date"), F.lit(version).alias("data_version"))
    stamped.write.mode("overwrite").partitionBy("source_name").parquet(folder)
    return records.sparkSession.read.schema(stamped.schema).parquet(folder)


def silver(table: DataFrame, factors: dict[str, float]) -> DataFrame:
    """Duplicates dropped, types enforced by suffix, units converted by column."""
    return rel.scale_columns(rel.type_by_suffix(table.dropDuplicates()), factors)


def gold(tables: dict[str, DataFrame], sheets: list[str] | None = None) -> DataFrame:
    """Union of the sources under a tag, then the catalogue formulas."""
    merged = rel.union_tagged(tables)
    return formulas.with_formulas(merged, formulas.catalogue(sheets))


def store(df: DataFrame, folder: str, name: str) -> DataFrame:
    return sinks.replace_table(df, f"{folder}/{name}")


def silver_name(bronze_name: str) -> str:
    """``raw_`` at the start becomes ``silver_``; inner matches stay."""
    return "silver_" + bronze_name.removeprefix("raw_")


def published_scores(scores: DataFrame, industry: str, score: str, horizons: list[str] = fixed.HORIZONS) -> DataFrame:
    """Scores per horizon with their name and percentile among peers."""
    ranked = win.percent_rank(scores, [industry], score, "percentile")
    rows = rel.with_each(ranked, "horizon_name", horizons)
    return rows.withColumn("score_name", tx.score_name(F.col(industry), F.col("horizon_name")))
