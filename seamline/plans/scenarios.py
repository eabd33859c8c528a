"""Scenario shifts, comparisons and Monte Carlo draws."""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline import fixed
from seamline.functions import numeric


def shifted(changes: dict[str, float]) -> dict[str, Column]:
    """Component columns with the scenario change, clipped to [0, 100].

    Metrics without a change keep their value unclipped.
    """
    return {
        m: numeric.clamp(F.col(m) + F.lit(float(changes[m])), 0, 100) if m in changes else F.col(m)
        for m in fixed.COMPONENT_WEIGHTS
    }


def scenario_score(changes: dict[str, float]) -> Column:
    """Weighted score after the change, computed inside the row."""
    terms = [c * F.lit(fixed.COMPONENT_WEIGHTS[m]) for m, c in shifted(changes).items()]
    return reduce(lambda a, b: a + b, terms)


def comparison(components: DataFrame, changes: dict[str, float]) -> DataFrame:
    """Baseline and scenario score per entity, change, percent and wording."""
    moved = shifted(changes)
    scores = components.select(
        "entity_id", scenario_score({}).alias("baseline"), scenario_score(changes).alias("scenario"),
        *[(moved[m] - F.col(m)).alias(f"impact_{m}") for m in changes],
    )
    change = F.col("scenario") - F.col("baseline")
    percent = numeric.percent_change(F.col("baseline"), F.col("scenario"))
    measured = scores.withColumns({"change": change, "percent": percent})
    text = F.concat(
        F.lit("The scenario results in a "), numeric.change_magnitude(F.col("percent")), F.lit(" "),
        F.when(F.col("change") > 0, "increase").otherwise("decrease"), F.lit(" by "),
        F.format_string("%.1f", F.round(F.abs("change"), 1)), F.lit(" points. Key drivers: "), F.lit(", ".join(list(changes)[:3])),
    )
    return measured.withColumn("explanation", text)


def uniform(*parts: Column) -> Column:
    """Repeatable draw in [0, 1) from a hash of its coordinates."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def normal(*parts: Column) -> Column:
    """Repeatable standard normal draw (Box-Muller)."""
    u1, u2 = uniform(*parts, F.lit("a")), uniform(*parts, F.lit("b"))
    return F.sqrt(-2 * F.ln(1 - u1)) * F.cos(2 * math.pi * u2)


def draw(kind: str, a: float, b: float, *parts: Column) -> Column:
    """normal(mean a, deviation b), uniform(a, b) or the fixed value a."""
    if kind == "normal":
        return a + b * normal(*parts)
    if kind == "uniform":
        return a + (b - a) * uniform(*parts)
    if kind == "fixed":
        return F.lit(float(a))
    raise ValueError(f"unknown distribution {kind}")


def drawn(metric: str, kind: str, a: float, b: float, n: int) -> np.ndarray:
    """Shifts of a metric in n draws, from md5 of draw and metric: the same for every row and engine."""

    def u(tail: str = "") -> np.ndarray:
        return np.array([int(hashlib.md5(f"{i}|{metric}{tail}".encode()).hexdigest()[:8], 16) / 2.0**32 for i in range(1, n + 1)])

    if kind == "normal":
        return a + b * np.sqrt(-2 * np.log(1 - u("|a"))) * np.cos(2 * np.pi * u("|b"))
    return a + (b - a) * u() if kind == "uniform" else np.full(n, a)


def monte_carlo(base: DataFrame, keys: list[str], shifts: dict[str, tuple[str, float, float]], n: int = 1000) -> DataFrame:
    """Spread of the score of each row of ``base`` over n draws: mean, std, p05, p25, p75, p95.

    The draws do not depend on the row, so they are a small table that every
    task holds; all scores of a row are made and summarised inside its batch and
    no row is shuffled or multiplied.
    """
    table = {m: drawn(m, *shift, n) for m, shift in shifts.items()}
    metrics, cuts = list(fixed.COMPONENT_WEIGHTS), [0.05, 0.25, 0.75, 0.95]

    @F.pandas_udf("mean double, std double, p05 double, p25 double, p75 double, p95 double")
    def spread_of(*columns: pd.Series) -> pd.DataFrame:
        values = np.column_stack([c.to_numpy("float64") for c in columns])
        out = np.empty((len(values), 6))
        for i in range(0, len(values), 512):
            part, score = values[i : i + 512], 0.0
            for k, m in enumerate(metrics):
                moved = np.clip(part[:, k, None] + table[m], 0, 100) if m in table else part[:, k, None]
                score = score + moved * fixed.COMPONENT_WEIGHTS[m]
            score = np.broadcast_to(score, (len(part), n))
            out[i : i + 512] = np.column_stack([score.mean(axis=1), score.std(axis=1), *np.quantile(score, cuts, axis=1)])
        return pd.DataFrame(out, columns=["mean", "std", "p05", "p25", "p75", "p95"]).replace({np.nan: None}).astype("float64")

    return base.select(*keys, spread_of(*[F.col(m).cast("double") for m in metrics]).alias("s")).select(*keys, "s.*")


def difference_interval(base_mean: Column, base_std: Column, other_mean: Column, other_std: Column, level: float) -> Column:
    """Normal interval of a difference, deviations combined in quadrature."""
    std = F.sqrt(base_std * base_std + other_std * other_std)
    return numeric.normal_interval(other_mean - base_mean, std, level)
