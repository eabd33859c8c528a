"""Total orders without a single-task sort.

Rows are range-partitioned on the full order and checkpointed, which fixes for
good which row lies in which segment. A hot key is spread over many segments;
what has to cross a segment boundary is one small row per segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamline.operators.relational import join_null_safe
from seamline.session import cut_lineage

_ROW_BITS = 33  # monotonically_increasing_id keeps the row index in the low 33 bits


def range_segments(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``_seg`` (segment number) and ``_pos`` (row index inside it).

    The number of segments is the shuffle width, from which adaptive execution
    merges neighbouring small ranges.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    row_id = F.monotonically_increasing_id()
    return cut_lineage(
        ordered.select(
            "*",
            F.shiftright(row_id, _ROW_BITS).cast("int").alias("_seg"),
            (row_id % F.lit(1 << _ROW_BITS)).alias("_pos"),
        )
    )


def segment_starts(totals: DataFrame, keys: list[str]) -> DataFrame:
    """Running total before each segment, and the total of the key.

    There is one row per key and segment it touches, so even a hot key has no
    more rows here than there are segments.
    """
    before = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        *keys, "_seg", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("_size"),
    )


def with_starts(seg: DataFrame, weight: Column, keys: list[str]) -> DataFrame:
    """Attach ``_start`` and ``_size`` to the rows of range segments."""
    starts = segment_starts(seg.groupBy(*keys, "_seg").agg(F.sum(weight).alias("_n")), keys)
    if keys:
        return join_null_safe(seg, starts, [*keys, "_seg"])
    return seg.join(F.broadcast(starts), "_seg")  # one row per segment


def global_row_number(df: DataFrame, order: list[str], name: str = "row_number") -> DataFrame:
    """1-based position of each row in the total order."""
    seg = range_segments(df, order)
    placed = with_starts(seg, F.lit(1), [])
    return placed.withColumn(name, F.col("_start") + F.col("_pos") + 1).drop("_seg", "_pos", "_start", "_size")


def exact_percentiles(
    df: DataFrame, value: str, probabilities: list[float], keys: list[str] | None = None, names: list[str] | None = None
) -> DataFrame:
    """Linearly interpolated percentiles per key group (whole frame if no keys).

    Equal values are merged first, so neither a hot group nor a hot value ends
    up in one task.
    """
    keys = list(keys or [])
    return percentiles_of(value_segments(df, value, keys), probabilities, keys, names)


def value_segments(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Non-null values with their counts (``_v``, ``_c``) in range segments per key."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    return range_segments(counted, [*keys, "_v"])


def percentiles_of(seg: DataFrame, probabilities: list[float], keys: list[str], names: list[str] | None = None) -> DataFrame:
    """Percentiles read off value segments."""
    names = names or [f"p{round(p * 100):02d}" for p in probabilities]
    inside = Window.partitionBy(*keys, "_seg").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = with_starts(seg, F.col("_c"), keys).withColumn("_in", F.sum("_c").over(inside))
    end = F.col("_start") + F.col("_in")
    begin = end - F.col("_c")

    def at(rank: Column) -> Column:
        return F.max(F.when((begin <= rank) & (rank < end), F.col("_v")))

    picks = []
    for p, name in zip(probabilities, names):
        rank = F.lit(float(p)) * (F.col("_size") - 1)
        picks += [at(F.floor(rank)).alias(f"_lo_{name}"), at(F.ceil(rank)).alias(f"_hi_{name}")]
    picked = placed.groupBy(*keys, "_size").agg(*picks)
    out = []
    for p, name in zip(probabilities, names):
        rank = F.lit(float(p)) * (F.col("_size") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * (rank - F.floor(rank))).alias(name))
    return picked.select(*keys, *out)


def nearest_rank(seg: DataFrame, percent: int, keys: list[str], name: str) -> DataFrame:
    """Smallest value that ``percent`` in a hundred of a key's values do not exceed, read off value segments."""
    inside = Window.partitionBy(*keys, "_seg").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = with_starts(seg, F.col("_c"), keys).withColumn("_in", F.sum("_c").over(inside))
    reached = 100 * (F.col("_start") + F.col("_in")) >= percent * F.col("_size")
    return placed.groupBy(*keys).agg(F.min(F.when(reached, F.col("_v"))).alias(name))


def carry_forward(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Last non-null value at or before each row within its key."""
    seg = range_segments(df, [*keys, *order])
    upto = Window.partitionBy(*keys, "_seg").orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = seg.withColumn("_local", F.last(value, ignorenulls=True).over(upto))
    tails = seg.groupBy(*keys, "_seg").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_pos"))).alias("_tail")
    )
    before = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(
        *keys, "_seg", F.last("_tail", ignorenulls=True).over(before).alias("_carry"),
        F.row_number().over(Window.partitionBy(*keys).orderBy("_seg")).alias("_nth"),
    ).where("_nth > 1").drop("_nth")
    # Only the key that straddles a segment boundary needs a carry: fewer rows than segments.
    return (
        join_null_safe(local, F.broadcast(carried), [*keys, "_seg"], "left")
        .withColumn(name, F.coalesce("_local", "_carry"))
        .drop("_seg", "_pos", "_local", "_carry")
    )


def as_of_join(
    requests: DataFrame, features: DataFrame, key: str, request_ts: str, feature_ts: str, columns: list[str], ttl_days: int
) -> DataFrame:
    """Latest feature row at or before each request, within a time to live."""
    marks = features.select(
        F.col(key), F.col(feature_ts).alias("_ts"), F.lit(0).alias("_kind"),
        F.struct(F.col(feature_ts).alias("feature_ts"), *columns).alias("_row"), F.lit(None).alias("_request"),
    )
    asks = requests.select(
        F.col(key), F.col(request_ts).alias("_ts"), F.lit(1).alias("_kind"), F.lit(None).alias("_row"),
        F.struct(*[c for c in requests.columns if c != key]).alias("_request"),
    )
    merged = carry_forward(marks.unionByName(asks), [key], ["_ts", "_kind"], "_row", "_latest")
    fresh = F.col("_latest.feature_ts") >= F.col("_ts") - F.make_dt_interval(F.lit(ttl_days))
    return merged.where("_kind = 1").select(
        key, "_request.*",
        *[F.when(fresh, F.col(f"_latest.{c}")).alias(c) for c in ["feature_ts", *columns]],
    )
