"""Projections, filters, joins and set operations."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamline.functions.numeric import nan_to_null

_FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


# --- filters and projections -------------------------------------------------

def where_equal(df: DataFrame, **terms) -> DataFrame:
    """Conjunction of equalities; a term that is None does not filter."""
    checks = [F.col(c) == F.lit(v) for c, v in terms.items() if v is not None]
    return df.where(reduce(and_, checks)) if checks else df


def where_since(df: DataFrame, ts: str, days: int, as_of: Column) -> DataFrame:
    return df.where(F.col(ts) >= as_of - F.make_dt_interval(F.lit(days)))


def latest_value(df: DataFrame, ts: str) -> Column:
    """Newest timestamp of a frame, as a scalar subquery."""
    return df.agg(F.max(ts)).scalar()


def where_keys_in(df: DataFrame, key: str, keys: DataFrame | list) -> DataFrame:
    """IN-list: literal for a list, semi join for a table of keys."""
    if isinstance(keys, list):
        return df.where(F.col(key).isin(keys))
    return df.join(keys.select(key).distinct(), key, "left_semi")


def drop_incomplete(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.na.drop(subset=columns)


def rename_known(df: DataFrame, names: dict[str, str], keep: list[str]) -> DataFrame:
    """Rename by a map, then keep the requested columns that exist."""
    renamed = df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})
    return renamed.select(*[c for c in keep if c in renamed.columns])


def columns_with_prefix(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def type_by_suffix(df: DataFrame) -> DataFrame:
    """``_date`` becomes a timestamp, ``_value`` and ``_amount`` a number; bad cells NULL."""
    typed = {}
    for c, dtype in df.dtypes:
        if c.endswith("_date") and not dtype.startswith("timestamp"):
            typed[c] = F.col(c).try_cast("timestamp")
        elif c.endswith(("_value", "_amount")):
            typed[c] = nan_to_null(F.col(c) if dtype == "double" else F.col(c).try_cast("double"))
    return df.withColumns(typed) if typed else df


def scale_columns(df: DataFrame, factors: dict[str, float]) -> DataFrame:
    """Unit conversion by an explicit column -> factor map."""
    return df.withColumns({c: F.col(c) * F.lit(f) for c, f in factors.items() if c in df.columns})


def missing_fields(**fields: Column) -> Column:
    """Names of the required fields that are NULL or blank."""
    checks = [F.when(F.coalesce(F.trim(c.cast("string")), F.lit("")) == "", F.lit(n)) for n, c in fields.items()]
    return F.array_compact(F.array(*checks))


# --- joins ---------------------------------------------------------------------

def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match each other; keys are kept once."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(other, on, how).drop(*[f"_r_{k}" for k in keys])


def with_group_stats(df: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """Attach group aggregates to every row.

    Aggregate-and-join instead of a whole-partition window: the aggregate
    combines map-side, and the join can split a hot key, so a group holding a
    third of the rows never sits in one task.
    """
    stats = df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggregates.items()])
    return join_null_safe(df, stats, keys)


def with_frame_stats(df: DataFrame, **aggregates: Column) -> DataFrame:
    """Attach whole-frame aggregates, computed once as a one-row subquery."""
    stats = df.agg(F.struct(*[a.alias(n) for n, a in aggregates.items()]).alias("s")).scalar()
    attached = df.withColumn("_stats", stats)
    return attached.select(*df.columns, *[F.col("_stats").getField(n).alias(n) for n in aggregates])


def snapshot_diff(current: DataFrame, previous: DataFrame, key: list[str], digest: str) -> DataFrame:
    """Status of every key of two snapshots: new, updated, unchanged, removed."""
    now = current.select(*key, F.col(digest).alias("current_hash"))
    before = previous.select(*key, F.col(digest).alias("previous_hash"))
    return now.join(before, key, "full").withColumn(
        "status",
        F.when(F.col("previous_hash").isNull(), "new")
        .when(F.col("current_hash").isNull(), "removed")
        .when(F.col("current_hash") != F.col("previous_hash"), "updated")
        .otherwise("unchanged"),
    )


def requested_rows(requests: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Each requested key, in its position, with NULLs where the table has no row."""
    return requests.join(table, key, "left")


def with_each(df: DataFrame, name: str, values: list) -> DataFrame:
    """Every row once per listed value (a generator, not a join)."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


# --- sets ----------------------------------------------------------------------

def union_tagged(frames: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    """Union of differing schemas; the key of each frame becomes a tag column."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def key_difference(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    return left.join(right.select(*key).distinct(), key, "left_anti")


# --- ordering ------------------------------------------------------------------

def page(df: DataFrame, order: list[str], skip: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(skip).limit(limit)


def first_per_key(df: DataFrame, keys: list[str], newest: list[Column]) -> DataFrame:
    """One row per key, the one with the greatest ordering tuple.

    An aggregate, not a window: the candidates of a hot key are reduced before
    the shuffle. With one ordering column and values of fixed width, each value
    has its own aggregate: that hashes, while structs and strings must be sorted.
    Ties then still take one row, since all aggregates see the rows in one order.
    """
    rest = [c for c in df.columns if c not in keys]
    if len(newest) == 1 and all(isinstance(f.dataType, _FIXED_WIDTH) for f in df.select(*newest, *rest).schema):
        return df.groupBy(*keys).agg(*[F.max_by(c, newest[0]).alias(c) for c in rest]).select(*keys, *rest)
    best = F.max_by(F.struct(*rest), F.struct(*newest)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """k best rows per key.

    A first cut inside salted parts of each key keeps at most k rows per part,
    so the final window sees a bounded number of rows even for a hot key.
    """
    salted = df.withColumn("_part", F.pmod(F.xxhash64(*df.columns), F.lit(64)))
    inner = Window.partitionBy(*keys, "_part").orderBy(*order)
    cut = salted.withColumn("_rn", F.row_number().over(inner)).where(F.col("_rn") <= k).drop("_rn", "_part")
    outer = Window.partitionBy(*keys).orderBy(*order)
    return cut.withColumn(rank, F.row_number().over(outer)).where(F.col(rank) <= k)
