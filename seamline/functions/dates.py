"""Date and time functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOOKBACK_DAYS = {"daily": 30, "weekly": 90, "monthly": 365}


def stamp(text: str) -> Column:
    """A timestamp literal that compares with zone-less columns without a cast."""
    return F.lit(text).cast("timestamp_ntz")


def lenient_timestamp(text: Column, fmt: str | None = None) -> Column:
    return F.try_to_timestamp(text, F.lit(fmt)) if fmt else F.try_to_timestamp(text)


def calendar_parts(ts: Column) -> list[Column]:
    return [F.year(ts).alias("metric_year"), F.quarter(ts).alias("metric_quarter"), F.month(ts).alias("metric_month")]


def iso_8601(ts: Column) -> Column:
    """Seconds precision, or microseconds when there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(ts, "SSSSSS")
    return F.when(fraction == "000000", whole).otherwise(F.concat(whole, F.lit("."), fraction))


def is_training_day(run_date: Column) -> Column:
    """Models are retrained on Mondays only."""
    return F.weekday(run_date) == 0


def lag_hours(latest: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(latest.cast("timestamp"))) / F.lit(3_600_000_000.0)
