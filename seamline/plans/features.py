"""Feature tables: derived ratios, bands, historical and online lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline import fixed
from seamline.operators import relational as rel


def country_features(gold: DataFrame, countries: DataFrame) -> DataFrame:
    """Country and day totals of the entity features."""
    return (
        gold.join(countries, "mine_id")
        .groupBy("country_code", "feature_date")
        .agg(
            F.round(F.sum("production_mt"), 4).alias("country_production"),
            F.avg("esg_score").alias("country_esg"),
            F.avg(F.try_divide(F.col("incidents") * 1000, F.col("n_events"))).alias("country_safety"),
            F.avg(F.try_divide("carbon", "production_mt")).alias("country_carbon_intensity"),
        )
    )


def derived_ratios() -> dict[str, Column]:
    """Declared ratios; a zero divisor yields no value."""
    c = F.col
    return {
        "f_capacity_utilization_rate": F.try_divide(c("production_mt"), c("capacity_mt")),
        "f_revenue_per_mt": F.try_divide(c("revenue"), c("production_mt")),
        "f_operating_margin": F.try_divide(c("revenue") - c("operating_cost"), c("revenue")),
        "f_safety_incident_rate": F.try_divide(c("incidents") * 1000, c("n_events")),
        "f_carbon_intensity": F.try_divide(c("carbon"), c("production_mt")),
        "f_reserve_life_years": F.try_divide(c("reserves"), c("production_mt")),
    }


def with_derived(gold: DataFrame) -> DataFrame:
    return gold.withColumns(derived_ratios())


def band(value: Column, edges: list[float], labels: list[str]) -> Column:
    """Label of the interval a value falls in; ``labels`` has one more entry."""
    out = F.when(value.isNull(), None)
    for edge, label in zip(edges, labels):
        out = out.when(value < edge, label)
    return out.otherwise(labels[-1])


def with_bands(df: DataFrame, bands: dict[str, tuple[str, list[float], list[str]]]) -> DataFrame:
    return df.withColumns({n: band(F.col(c), edges, labels) for n, (c, edges, labels) in bands.items()})


def historical(gold: DataFrame, start: Column, end: Column, wanted: list[str], freshness: float = 0.7) -> DataFrame:
    """Fresh rows of a date range under their feature names."""
    rows = gold.where(F.col("feature_date").between(start, end) & (F.col("feature_freshness_score") >= freshness))
    return rel.rename_known(rows, fixed.FEATURE_NAMES, ["mine_id", "feature_date", *wanted])


def online(gold: DataFrame, requests: DataFrame, as_of: Column, wanted: list[str], ttl_days: int = 7) -> DataFrame:
    """Latest row within the time to live for each requested entity."""
    recent = rel.where_since(gold, "feature_date", ttl_days, as_of)
    latest = rel.first_per_key(recent, ["mine_id"], [F.col("feature_date")])
    named = rel.rename_known(latest, fixed.FEATURE_NAMES, ["mine_id", "feature_date", *wanted])
    return rel.requested_rows(requests, named, "mine_id")


class FeatureRegistry:
    """Run-time registry of feature name -> column builder."""

    def __init__(self):
        self._builders: dict[str, Column] = {}

    def register(self, name: str, column: Column) -> None:
        self._builders[name] = column

    def apply(self, df: DataFrame, names: list[str] | None = None) -> DataFrame:
        chosen = names or list(self._builders)
        return df.withColumns({n: self._builders[n] for n in chosen})


def lineage(features: DataFrame, source_table: str, version: str) -> DataFrame:
    """Lineage of the feature columns a frame really has."""
    types = dict(features.dtypes)
    rows = [
        (name, types[name], category, unit, source_table, version)
        for name, (category, unit) in fixed.DERIVED_FEATURES.items()
        if name in types
    ]
    return features.sparkSession.createDataFrame(
        rows, "feature string, dtype string, category string, unit string, source_table string, version string"
    )


def most_active(gold: DataFrame, n: int, days: int = 30, freshness: float = 0.7, as_of: Column | None = None) -> DataFrame:
    """Entities with the most fresh days in the lookback, best first."""
    recent = rel.where_since(gold, "feature_date", days, rel.latest_value(gold, "feature_date") if as_of is None else as_of)
    days_seen = recent.where(F.col("feature_freshness_score") >= freshness).select("mine_id", "feature_date").distinct()
    counts = days_seen.groupBy("mine_id").agg(F.count("*").alias("active_days"))
    return counts.orderBy(F.col("active_days").desc(), "mine_id").limit(n)


def entity_matrix(gold: DataFrame, n: int, order: list[str]) -> DataFrame:
    """Latest features of the n most active entities as columns x1, x2, …; 0 when missing."""
    chosen = most_active(gold, n)
    latest = rel.first_per_key(rel.where_keys_in(gold, "mine_id", chosen), ["mine_id"], [F.col("feature_date")])
    cells = [
        (F.coalesce(F.col(c), F.lit(0.0)) if c in gold.columns else F.lit(0.0)).alias(f"x{i + 1}") for i, c in enumerate(order)
    ]
    return latest.select("mine_id", *cells)
