"""Metric weights in long form: quality, information gain, smoothing, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamline import fixed
from seamline.functions import numeric
from seamline.functions import text as tx
from seamline.operators import relational as rel
from seamline.operators import windows as win
from seamline.operators.segments import exact_percentiles
from seamline.session import cut_lineage

DEFAULT_WEIGHT = 0.5


def quality_weights(df: DataFrame, features: list[str]) -> DataFrame:
    """Quality weight of every feature column, from one pass.

    Freshness is 1; coverage the non-null share; confidence 1 / (1 + cv) with
    the population deviation. A column without values weighs 0.
    """
    stats = df.agg(F.count("*").alias("_rows"), *[
        F.struct(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c) for c in features
    ])
    long = stats.select("_rows", F.inline(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(f"{c}.n").alias("n"), F.col(f"{c}.mean").alias("mean"), F.col(f"{c}.std").alias("std"))
        for c in features
    ])))
    cv = F.when(F.col("mean") == 0, 0.0).otherwise(F.try_divide("std", "mean"))
    score = numeric.quality_score(F.lit(1.0), F.try_divide("n", "_rows"), F.try_divide(F.lit(1.0), 1 + cv))
    return long.select("metric", F.when(F.col("n") == 0, 0.0).otherwise(score).alias("quality"))


def information_gain(df: DataFrame, features: list[str], target: str, bins: int = 10) -> DataFrame:
    """Mutual information of each feature with the target over equal-width bins.

    One scan finds the ranges, one counts the joint cells; what is shuffled is
    the bounded histogram (features × bins²), never the rows. A missing feature
    counts as 0 and a missing target as the mean. Gains are scaled by the
    greatest one.
    """
    columns = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features}
    columns[target] = F.col(target).cast("double")
    ranges = df.agg(F.struct(F.avg(target).alias("_mean"), *[
        F.struct(F.min(x).alias("lo"), F.max(x).alias("hi")).alias(c) for c, x in columns.items()
    ])).scalar()
    columns[target] = F.coalesce(columns[target], F.col("_ranges._mean"))

    def bin_of(c: str) -> Column:
        lo, hi = F.col(f"_ranges.{c}.lo"), F.col(f"_ranges.{c}.hi")
        place = F.floor(F.try_divide(columns[c] - lo, hi - lo) * bins)
        return F.coalesce(F.least(place, F.lit(bins - 1)), F.lit(0)).cast("int")

    cells = df.withColumn("_ranges", ranges).select(
        bin_of(target).alias("y"),
        F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), bin_of(c).alias("x")) for c in features])).alias("cell"),
    )
    joint = cells.groupBy("cell.metric", "cell.x", "y").agg(F.count("*").alias("n"))
    # Windows below run over at most bins² histogram rows per feature.
    by_x, by_y, whole = Window.partitionBy("metric", "x"), Window.partitionBy("metric", "y"), Window.partitionBy("metric")
    total = F.sum("n").over(whole)
    ratio = F.col("n") * total / (F.sum("n").over(by_x) * F.sum("n").over(by_y))
    terms = joint.select("metric", (F.col("n") / total * F.ln(ratio)).alias("term"))
    gains = terms.groupBy("metric").agg(F.greatest(F.sum("term"), F.lit(0.0)).alias("raw_gain"))
    top = F.max("raw_gain").over(Window.partitionBy())  # one row per feature
    return gains.withColumn("gain", F.when(top > 0, F.col("raw_gain") / top).otherwise(F.col("raw_gain")))


def combine(base: DataFrame, quality: DataFrame, gain: DataFrame, horizon: str) -> DataFrame:
    """base × (quality + gain) / 2; a part that is absent counts as 1."""
    one = F.lit(1.0)
    joined = base.join(quality, "metric", "left").join(gain.select("metric", "gain"), "metric", "left")
    b, q, g = (F.coalesce(c, one) for c in ("base", "quality", "gain"))
    key = tx.strip_prefix(F.col("metric"), "f_")
    return joined.select(
        "metric", tx.weight_name(key, F.lit(horizon)).alias("weight_name"), b.alias("base"), q.alias("quality"), g.alias("gain"),
        (b * (0.5 * q + 0.5 * g)).alias("weight"),
    )


def override(weights: DataFrame, overrides: DataFrame) -> DataFrame:
    """Replace known weights; unknown names are ignored."""
    new = overrides.select("weight_name", F.col("weight").alias("_new"))
    return weights.join(new, "weight_name", "left").withColumn("weight", F.coalesce("_new", "weight")).drop("_new")


def to_unit_sum(weights: DataFrame, weight: str = "weight", keys: list[str] | None = None) -> DataFrame:
    """Scale to sum 1; a zero total leaves the weights as they are."""
    if keys:
        stated = rel.with_group_stats(weights, keys, _total=F.sum(weight))
    else:
        stated = rel.with_frame_stats(weights, _total=F.sum(weight))
    scaled = F.when(F.col("_total") == 0, F.col(weight)).otherwise(F.try_divide(weight, "_total"))
    return stated.withColumn(weight, scaled).drop("_total")


def smoothed_value(old: Column, gain: Column, keep: float = 0.8) -> Column:
    return numeric.clamp(keep * old + (1 - keep) * gain, 0.1, 1.0)


def smoothed(gains: DataFrame, active: DataFrame, keep: float = 0.8) -> DataFrame:
    """keep · old + (1 − keep) · gain, clamped to [0.1, 1]."""
    old = F.coalesce("weight_value", F.lit(DEFAULT_WEIGHT))
    joined = gains.join(active.withColumnRenamed("metric_slug", "metric"), "metric", "left")
    return joined.select(
        "metric", old.alias("old_weight"), "gain",
        smoothed_value(old, F.col("gain"), keep).alias("new_weight"),
    )


def requested(slugs: DataFrame, active: DataFrame) -> DataFrame:
    return slugs.join(active, "metric_slug", "left").select(
        "metric_slug", F.coalesce("weight_value", F.lit(DEFAULT_WEIGHT)).alias("weight_value")
    )


def changes(gains: DataFrame, active: DataFrame) -> DataFrame:
    """Change of each metric from its active weight to its gain."""
    old = F.coalesce("weight_value", F.lit(DEFAULT_WEIGHT))
    joined = gains.join(active.withColumnRenamed("metric_slug", "metric"), "metric", "left")
    changed = joined.select("metric", old.alias("old_weight"), "gain", F.round(F.col("gain") - old, 9).alias("change"))
    pct = F.when(F.col("old_weight") > 0, F.col("change") / F.col("old_weight") * 100).otherwise(0.0)
    return changed.withColumn("change_pct", pct)


def movers(changed: DataFrame, k: int = 5) -> DataFrame:
    """k largest increases and k largest decreases, ties broken by name."""
    up = changed.orderBy(F.col("change").desc(), "metric").limit(k).select(F.lit("increase").alias("side"), "*")
    down = changed.orderBy(F.col("change"), "metric").limit(k).select(F.lit("decrease").alias("side"), "*")
    return up.unionByName(down)


def rotate(table: DataFrame, fresh: DataFrame, at: Column) -> DataFrame:
    """Deactivate the active rows and append the new generation."""
    closed = table.withColumn("updated_at", F.when(F.col("is_active"), at).otherwise(F.col("updated_at"))).withColumn(
        "is_active", F.lit(False)
    )
    opened = fresh.select(
        "metric_slug", "weight_value", F.lit(True).alias("is_active"), at.alias("created_at"), at.alias("updated_at")
    )
    return closed.unionByName(opened)


def history(versions: DataFrame, slug: str, order: str, value: str) -> DataFrame:
    """Old value, new value and change per update of a slug (one row per day)."""
    w = Window.partitionBy(slug).orderBy(order)
    return (
        versions.withColumn("old_weight", F.lag(value).over(w))
        .where("old_weight IS NOT NULL")
        .withColumn("change", F.col(value) - F.col("old_weight"))
        .withColumnRenamed(value, "new_weight")
    )


def gain_by_feature(gold: DataFrame, features: list[str], score: str, since: Column, fresh: float = 0.7, bins: int = 10) -> DataFrame:
    """Gain of each feature about the size of the score change, under metric slugs.

    The lookback precedes the changes, so the first row in it has none. Changes
    come from all rows, features from those that are fresh.
    """
    recent = gold.where(F.col("feature_date") >= since)
    changed = win.deltas(recent, "mine_id", "feature_date", score).where(F.col("delta").isNotNull())
    rows = changed.where(F.col(score) >= fresh).select("abs_delta", *features)
    rows = cut_lineage(rows)  # read three times below
    long = rows.unpivot([], features, "metric", "value")
    medians = exact_percentiles(long, "value", [0.5], ["metric"], ["median"])
    by_name = medians.agg(F.map_from_entries(F.collect_list(F.struct("metric", "median")))).scalar()  # one per feature
    filled = rows.withColumn("_medians", by_name).withColumns({
        c: F.coalesce(F.col(c), F.try_element_at("_medians", F.lit(c)), F.lit(0.0)) for c in features
    })
    gains = information_gain(filled.drop("_medians"), features, "abs_delta", bins)
    slugs = F.create_map(*[F.lit(x) for pair in fixed.METRIC_SLUGS.items() for x in pair])
    return gains.withColumn("metric", F.coalesce(F.try_element_at(slugs, F.col("metric")), F.col("metric")))


def by_horizon(weights: DataFrame, horizons: list[str] = fixed.HORIZONS) -> DataFrame:
    rows = rel.with_each(weights, "horizon", horizons)
    return rows.withColumn("weight_name", tx.weight_name(tx.strip_prefix(F.col("metric"), "f_"), F.col("horizon")))
