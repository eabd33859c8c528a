"""Ordered and partition-relative computations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamline.functions import numeric
from seamline.operators.relational import join_null_safe, with_frame_stats, with_group_stats
from seamline.operators.segments import carry_forward, exact_percentiles, global_row_number, range_segments, with_starts


def deltas(df: DataFrame, key: str, order: str, value: str, threshold: float = 0.1,
           labels=("INCREASE", "DECREASE", "STABLE")) -> DataFrame:
    """Change against the previous row of the key; first rows drop out.

    The input has one row per key and period, so a key is as long as the
    calendar, however hot it was before aggregation.
    """
    previous = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    delta = F.round(F.col(value) - F.col("previous_value"), 9)
    return (
        df.withColumn("previous_value", previous)
        .where(F.col("previous_value").isNotNull())
        .withColumn("delta", delta)
        .withColumn("abs_delta", F.abs("delta"))
        .withColumn("direction", numeric.direction(F.col("delta"), threshold, labels))
    )


def at_group_maximum(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows equal to the group maximum, ties kept; NULL keys never match."""
    best = df.groupBy(*keys).agg(F.max(value).alias(value))
    return df.join(best, [*keys, value], "left_semi")


def forward_fill(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    return carry_forward(df, keys, order, value, name).withColumn(name, F.coalesce(name, F.lit(0.0)))


def fill_missing(df: DataFrame, value: str, method: str, name: str) -> DataFrame:
    """Fill by mean, median or zero; an all-missing column becomes 0."""
    if method == "zero":
        fill = F.lit(0.0)
    elif method == "mean":
        fill = df.agg(F.avg(value)).scalar()
    elif method == "median":
        fill = exact_percentiles(df, value, [0.5], names=["m"]).scalar()
    else:
        raise ValueError(f"unknown fill method {method}")
    return df.withColumn(name, F.coalesce(F.col(value), fill, F.lit(0.0)))


def normalise(df: DataFrame, value: str, method: str, name: str, keys: list[str] | None = None) -> DataFrame:
    """Column to 0-100 by min_max or z_score, over the frame or per key group."""
    v = F.col(value)
    stats = {"_lo": F.min(v), "_hi": F.max(v)} if method == "min_max" else {"_mean": F.avg(v), "_std": F.stddev_pop(v)}
    with_stats = with_group_stats(df, keys, **stats) if keys else with_frame_stats(df, **stats)
    if method == "min_max":
        out = numeric.min_max_100(v, F.col("_lo"), F.col("_hi"))
    elif method == "z_score":
        out = numeric.z_100(v, F.col("_mean"), F.col("_std"))
    else:
        raise ValueError(f"unknown normalisation {method}")
    return with_stats.withColumn(name, out).drop(*stats)


def sorted_curve(df: DataFrame, row_order: list[str], value: str, name: str) -> DataFrame:
    """Row i (by ``row_order``) receives the i-th smallest value of the column."""
    rows = global_row_number(df, row_order, "_n")
    # The row order breaks ties, so a value that many rows share is spread over segments.
    curve = global_row_number(df.select(F.col(value).alias(name), *[F.col(c).alias(f"_tie_{i}") for i, c in enumerate(row_order)]), [name, *[f"_tie_{i}" for i in range(len(row_order))]], "_n")
    curve = curve.select(name, "_n")
    return rows.join(curve, "_n").drop("_n")


def standardise(df: DataFrame, columns: list[str], prefix: str = "z_") -> DataFrame:
    """Population standard scores; a constant column is divided by 1."""
    stats = {}
    for c in columns:
        stats[f"_m_{c}"] = F.avg(c)
        stats[f"_s_{c}"] = F.stddev_pop(c)
    scored = with_frame_stats(df, **stats)
    return scored.withColumns({
        f"{prefix}{c}": (F.col(c) - F.col(f"_m_{c}")) / F.coalesce(F.nullif(F.col(f"_s_{c}"), F.lit(0.0)), F.lit(1.0))
        for c in columns
    }).drop(*stats)


def z_scores(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    v = F.col(value)
    scored = with_group_stats(df, keys, _mean=F.avg(v), _std=F.stddev_samp(v), _n=F.count(v))
    return scored.withColumn(name, numeric.z_score(v, F.col("_mean"), F.col("_std"), F.col("_n"))).drop("_mean", "_std", "_n")


def percent_rank(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Percent rank (0-100) within a key group, ties sharing the lowest rank.

    Ranks are running counts over merged values in range segments, so a hot
    group is spread over tasks.
    """
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    seg = range_segments(counted, [*keys, value])
    inside = Window.partitionBy(*keys, "_seg").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = with_starts(seg, F.col("_c"), keys).withColumn("_in", F.coalesce(F.sum("_c").over(inside), F.lit(0)))
    ranked = placed.select(
        *keys, value,
        F.when(F.col("_size") > 1, (F.col("_start") + F.col("_in")) / (F.col("_size") - 1) * 100).otherwise(F.lit(0.0)).alias(name),
    )
    return join_null_safe(df, ranked, [*keys, value])


def time_blocks(df: DataFrame, order: list[str], n_splits: int) -> DataFrame:
    """Each row once with its ``block`` of expanding folds.

    Fold f (from 0) tests block f + 1 and trains on all blocks before. Test blocks have
    n // (k + 1) rows and sit at the end; block 0 is what lies before them.
    """
    numbered = global_row_number(df, order, "_n")
    n = df.agg(F.count("*")).scalar()
    size = F.floor(n / (n_splits + 1))
    past = F.col("_n") - 1 - (n - n_splits * size)
    return numbered.withColumn("block", F.when(past < 0, 0).otherwise(F.floor(F.try_divide(past, size)) + 1).cast("int")).drop("_n")


def expanding_folds(df: DataFrame, order: list[str], n_splits: int) -> DataFrame:
    """Time-ordered folds: each row once per fold, as train or test.

    Rows after a fold's test block are not part of that fold.
    """
    blocks = time_blocks(df, order, n_splits).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    part = F.when(F.col("block") <= F.col("fold"), "train").when(F.col("block") == F.col("fold") + 1, "test")
    return blocks.withColumn("part", part).where("part IS NOT NULL").drop("block")


def label_codes(df: DataFrame, column: str, name: str) -> DataFrame:
    """Codes 0, 1, … in sorted order of the distinct values."""
    codes = global_row_number(df.select(column).distinct(), [column], "_n")
    return join_null_safe(df, codes.withColumn(name, F.col("_n") - 1).drop("_n"), [column])


def appearance_codes(df: DataFrame, column: str, order: str, name: str) -> DataFrame:
    """Codes 0, 1, … in order of first appearance."""
    first = df.groupBy(column).agg(F.min(order).alias("_first"))
    codes = global_row_number(first, ["_first", column], "_n")
    return join_null_safe(df, codes.select(column, (F.col("_n") - 1).alias(name)), [column])


def outliers(df: DataFrame, value: str, method: str) -> DataFrame:
    """Rows whose value is an outlier of the whole column."""
    v = F.col(value)
    if method == "iqr":
        q = exact_percentiles(df, value, [0.25, 0.75], names=["q1", "q3"])
        reach = 1.5 * (F.col("q3") - F.col("q1"))
        bounds = q.select(F.struct((F.col("q1") - reach).alias("lo"), (F.col("q3") + reach).alias("hi"))).scalar()
        checked = df.withColumn("_b", bounds)
        return checked.where((v < F.col("_b.lo")) | (v > F.col("_b.hi"))).drop("_b")
    if method == "z_score":
        scored = with_frame_stats(df, _mean=F.avg(v), _std=F.stddev_pop(v))
        return scored.where(F.abs(F.try_divide(v - F.col("_mean"), F.col("_std"))) > 3).drop("_mean", "_std")
    if method == "modified_z_score":
        median = exact_percentiles(df, value, [0.5], names=["m"]).scalar()
        gap = df.where(v.isNotNull()).select(F.abs(v - median).alias("gap"))
        mad = exact_percentiles(gap, "gap", [0.5], names=["m"]).scalar()
        score = F.abs(F.try_divide(0.6745 * (v - F.col("_median")), F.col("_mad")))
        checked = df.withColumns({"_median": median, "_mad": mad})
        return checked.where(F.when(F.col("_mad") == 0, v != F.col("_median")).otherwise(score > 3.5)).drop("_median", "_mad")
    raise ValueError(f"unknown outlier method {method}")


def last_rows(df: DataFrame, order: list[Column], ascending: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n).orderBy(*ascending)


def split_at_quantile(df: DataFrame, ts: str, q: float) -> DataFrame:
    """Tags rows train (at or before the date quantile) or test."""
    micros = df.select(F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"))
    cut = exact_percentiles(micros, "_t", [q], names=["cut"]).scalar()
    return df.withColumn("part", F.when(F.unix_micros(F.col(ts).cast("timestamp")) <= cut, "train").otherwise("test"))


def top_contributions(df: DataFrame, key: str, contributions: dict[str, Column], k: int) -> DataFrame:
    """k largest absolute contributions per sample, ranked inside the row: no shuffle."""
    items = F.array(*[
        F.struct((-F.abs(c)).alias("o"), F.lit(name).alias("feature"), c.alias("contribution")) for name, c in contributions.items()
    ])
    best = F.posexplode(F.slice(F.array_sort(items), 1, k)).alias("_at", "_item")
    return df.select(key, best).select(key, "_item.feature", "_item.contribution", (F.col("_at") + 1).alias("rank"))


def fill_and_normalise(df: DataFrame, columns: list[str], fill: str, method: str) -> DataFrame:
    """Fill, then scale several columns; all moments come from one aggregate pass.

    With mean filling, the filled column's range and mean follow from the
    moments of the gappy one, so no second pass is needed for them.
    """
    if fill not in ("mean", "zero") or method != "min_max":
        for c in columns:
            df = normalise(fill_missing(df, c, fill, c), c, method, c)
        return df
    value = {c: F.col(c) for c in columns}
    if fill == "zero":
        value = {c: F.coalesce(x, F.lit(0.0)) for c, x in value.items()}
    stats = df.agg(F.struct(*[
        F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"), F.avg(x).alias("mean")).alias(c) for c, x in value.items()
    ])).scalar()
    out = {}
    for c, x in value.items():
        s = F.col("_stats").getField(c)
        filled = F.coalesce(x, s.getField("mean"), F.lit(0.0))
        lo, hi = (F.coalesce(s.getField(k), F.lit(0.0)) for k in ("lo", "hi"))
        out[c] = numeric.min_max_100(filled, lo, hi)
    return df.withColumn("_stats", stats).withColumns(out).drop("_stats")
