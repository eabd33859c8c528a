"""Numeric functions over columns."""

from __future__ import annotations

from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

from seamline import fixed


def nan_to_null(x: Column) -> Column:
    """NULL is the only missing value; NaN is mapped to it where data enters."""
    return F.nanvl(x, F.lit(None).cast("double"))


def row_mean(*cols: Column) -> Column:
    return reduce(lambda a, b: a + b, cols) / F.lit(float(len(cols)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def divide(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def z_score(x: Column, mean: Column, std: Column, n: Column) -> Column:
    flat = (n <= 1) | (std == 0)
    return F.when(x.isNotNull() & flat, F.lit(0.0)).otherwise(F.try_divide(x - mean, std))


def min_max_100(x: Column, lo: Column, hi: Column) -> Column:
    return F.when(x.isNull(), None).when(hi == lo, F.lit(50.0)).otherwise(F.try_divide(x - lo, hi - lo) * 100)


def z_100(x: Column, mean: Column, std: Column) -> Column:
    return (
        F.when(x.isNull(), None)
        .when(std == 0, F.lit(50.0))
        .otherwise(clamp((F.try_divide(x - mean, std) + 3) / 6 * 100, 0.0, 100.0))
    )


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x)))


def confidence_seed(structured, country, sub_industry, volume, fillable) -> Column:
    terms = [structured, country, sub_industry, volume, fillable]
    return sum((F.coalesce(t, F.lit(0)) for t in terms[1:]), F.coalesce(terms[0], F.lit(0))) / F.lit(5.0)


def confidence_trigger(structured, country, sub_industry, volume, fillable, longitudinal, bias, interdependence) -> Column:
    straight = [structured, country, sub_industry, volume, fillable, longitudinal]
    inverted = [6 - bias, 6 - interdependence]
    return reduce(lambda a, b: a + b, [F.coalesce(t, F.lit(0)) for t in straight + inverted]) / F.lit(8.0)


def confidence_application(
    structured, country, sub_industry, volume, proxy, fillable, longitudinal, bias, interdependence
) -> Column:
    straight = [F.coalesce(t, F.lit(0)) for t in (structured, country, sub_industry, volume, proxy, fillable, longitudinal)]
    inverted = [6 - F.coalesce(F.nullif(t, F.lit(0)), F.lit(3)) for t in (bias, interdependence)]
    return reduce(lambda a, b: a + b, straight + inverted) / F.lit(9.0)


def quality_score(freshness: Column, coverage: Column, confidence: Column) -> Column:
    w = fixed.QUALITY_COMPONENTS
    return w["freshness"] * freshness + w["coverage"] * coverage + w["confidence"] * confidence


def percent_change(old: Column, new: Column) -> Column:
    return F.coalesce(F.try_divide(new - old, old) * 100, F.lit(0.0))


def change_magnitude(percent: Column) -> Column:
    size = F.abs(percent)
    return F.when(size > 5, "significant").when(size > 2, "moderate").otherwise("minor")


def score_band(score: Column) -> Column:
    return F.when(score > 60, "high").when(score > 40, "moderate").otherwise("low")


def quality_band(score: Column) -> Column:
    return F.when(score >= 0.9, "Excellent").when(score >= 0.7, "Good").otherwise("Needs Improvement")


def direction(delta: Column, threshold: float, labels=("INCREASE", "DECREASE", "STABLE")) -> Column:
    up, down, flat = labels
    return F.when(delta > threshold, up).when(delta < -threshold, down).otherwise(flat)


def z_for_level(level: float) -> float:
    return NormalDist().inv_cdf((1 + level) / 2)


def normal_interval(mean: Column, std: Column, level: float) -> Column:
    z = z_for_level(level)
    return F.struct((mean - z * std).alias("lower"), (mean + z * std).alias("upper"))


def normal_cdf(x: Column) -> Column:
    """Standard normal law; beyond seven deviations the tail is below 1e-12 and counts as 0."""

    def polynomial(terms: list[float]) -> Column:
        return reduce(lambda total, term: total * size + term, terms[1:], F.lit(terms[0]))

    size = F.abs(x)
    tail = F.exp(-size * size / 2) * polynomial(fixed.NORMAL_NUMERATOR) / polynomial(fixed.NORMAL_DENOMINATOR)
    tail = F.when(size < 7, tail).when(size >= 7, 0.0)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def probability_positive(mean_difference: Column, std: Column) -> Column:
    """P(difference > 0) under a normal law."""
    return normal_cdf(F.try_divide(mean_difference, std))


def response_confidence(citations: Column, mean_similarity: Column, length: Column) -> Column:
    return row_mean(
        F.when(citations >= 2, 0.8).otherwise(0.4),
        F.coalesce(mean_similarity, F.lit(0.2)),
        F.when(length.between(200, 2000), 0.8).otherwise(0.6),
    )


def health_colour(value: Column, threshold: Column) -> Column:
    return F.when(value >= threshold, "red").when(value >= threshold * 0.8, "yellow").otherwise("green")


def health_level(value: Column, moderate: Column, high: Column) -> Column:
    return F.when(value >= high, "High").when(value >= moderate, "Moderate").otherwise("Low")
