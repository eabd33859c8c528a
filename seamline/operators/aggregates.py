"""Grouped and whole-frame summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline import fixed
from seamline.functions import numeric
from seamline.operators.relational import join_null_safe
from seamline.operators.segments import percentiles_of, value_segments


def metric_summary(definitions: DataFrame, values: DataFrame, sources: DataFrame, approximate: bool = False, tasks: int | None = None) -> DataFrame:
    """Counts, distinct industries and countries, year span and mean per metric.

    Values are reduced per (metric, industry, country) before the distinct
    counts, and per metric before the joins. ``tasks`` is how many tasks share
    the values, so that the cells one holds need not grow with the input.
    """
    cell = ["definition_id", "sub_industry", "country"]
    cells = (values.repartition(tasks, *cell) if tasks else values).groupBy(*cell).agg(
        F.count("*").alias("n"), F.min("year").alias("y0"), F.max("year").alias("y1"),
        F.sum("normalized_value").alias("s"), F.count("normalized_value").alias("k"),
    )
    # A set a metric is as small as the list of industries or countries; count_distinct would copy and shuffle the cells again.
    distinct = F.approx_count_distinct if approximate else lambda c: F.size(F.collect_set(c)).cast("long")
    per_metric = (cells.repartition(tasks, "definition_id") if tasks else cells).groupBy("definition_id").agg(
        F.sum("n").alias("value_count"),
        distinct("sub_industry").alias("industry_count"),
        distinct("country").alias("country_count"),
        F.min("y0").alias("earliest_year"),
        F.max("y1").alias("latest_year"),
        F.try_divide(F.sum("s"), F.sum("k")).alias("avg_normalized_value"),
    )
    counts = ["value_count", "industry_count", "country_count"]
    return (
        definitions.join(per_metric, "definition_id", "left")
        .join(sources.select("source_id", F.col("name").alias("data_source_name")), "source_id", "left")
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    )


def coverage(df: DataFrame, column: str) -> DataFrame:
    return df.agg(
        F.count("*").alias("total"), F.count(column).alias("present"),
        F.coalesce(F.try_divide(F.count(column), F.count("*")), F.lit(0.0)).alias("coverage"),
    )


def spread(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(keys or [])).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("minimum"),
        F.max(value).alias("maximum"), F.stddev_pop(value).alias("std"),
    )


def regression_quality(df: DataFrame, actual: str, predicted: str, keys: list[str] | None = None) -> DataFrame:
    """RMSE, R² and MAE in one pass."""
    y, p = F.col(actual), F.col(predicted)
    residual = F.pow(y - p, 2)
    return df.groupBy(*(keys or [])).agg(
        F.count("*").alias("n"),
        F.sqrt(F.avg(residual)).alias("rmse"),
        (1 - F.try_divide(F.avg(residual), F.var_pop(y))).alias("r2"),
        F.avg(F.abs(y - p)).alias("mae"),
    )


def null_profile(df: DataFrame) -> DataFrame:
    """One row per column: type, rows and NULL count, from a single pass."""
    types = dict(df.dtypes)
    counts = df.agg(
        F.count("*").alias("_rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns]
    )
    rows = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(types[c]).alias("column_type"), F.col(f"`{c}`").alias("null_count"))
        for c in df.columns
    ])
    return counts.select(F.col("_rows").alias("row_count"), F.inline(rows))


def weighted_score(weights: dict[str, float] = fixed.COMPONENT_WEIGHTS) -> Column:
    """Σ metric × weight over wide component columns."""
    return reduce(lambda a, b: a + b, [F.col(m) * F.lit(w) for m, w in weights.items()])


def percentile_summary(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """5/25/75/95 percentiles with mean and deviation."""
    keys = list(keys or [])
    seg = value_segments(df, value, keys)  # fixed on disk: percentiles and moments both read it
    marks = percentiles_of(seg, [0.05, 0.25, 0.75, 0.95], keys)
    n, total = F.sum("_c"), F.sum(F.col("_v") * F.col("_c"))
    spread = F.sum(F.col("_v") * F.col("_v") * F.col("_c")) / n - F.pow(total / n, 2)
    moments = seg.groupBy(*keys).agg((total / n).alias("mean"), F.sqrt(F.greatest(spread, F.lit(0.0))).alias("std"))
    if keys:
        return join_null_safe(moments, marks, keys)
    both = moments.withColumn("_m", marks.select(F.struct("*")).scalar())
    return both.select("mean", "std", "_m.*")


def data_quality(dimensions: list[str]) -> list[Column]:
    overall = numeric.row_mean(*[F.col(d) for d in dimensions])
    return [overall.alias("overall"), numeric.quality_band(overall).alias("band")]


def ratio(hit: Column) -> Column:
    return F.coalesce(F.try_divide(F.count_if(hit), F.count("*")), F.lit(0.0))


def session_summary(messages: DataFrame, key: str, role: str, response_ms: str, topics: Column) -> DataFrame:
    """Message counts per role, mean non-zero response time and topics.

    Topics are at most as many as the topic list, so the set stays small even
    for a session holding a third of all messages.
    """
    said = F.when(F.col(role) == "user", topics)
    return messages.groupBy(key).agg(
        F.count("*").alias("total_messages"),
        F.count_if(F.col(role) == "user").alias("user_messages"),
        F.count_if(F.col(role) == "assistant").alias("assistant_messages"),
        F.coalesce(F.avg(F.nullif(F.col(response_ms), F.lit(0))), F.lit(0.0)).alias("avg_response_ms"),
        F.array_join(
            F.array_sort(F.array_distinct(F.flatten(F.collect_set(said)))), ", "
        ).alias("topics"),
    )
