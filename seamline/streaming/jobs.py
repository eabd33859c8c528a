"""Incremental jobs on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.operators.relational import first_per_key
from seamline.operators.segments import nearest_rank, range_segments
from seamline.plans import weights
from seamline.sources import feeds
from seamline.sources.keyed_table import KeyedTable, create
from seamline.streaming import runner
from seamline.streaming.changes import detect_changes  # noqa: F401 - one of the jobs


def ingest_feeds(spark: SparkSession, landing: str, out: str, checkpoint: str) -> None:
    """New response files become envelope rows exactly once."""
    raw = runner.stream_files(spark, landing, feeds.ENVELOPE, "json")
    runner.append_all(feeds.with_provenance(raw), out, checkpoint)


def request_counts(requests: DataFrame, length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Requests, errors and predictions per operation and tumbling window."""
    kind = F.col("event_type")
    return (
        runner.timed(requests, "ts", late)
        .groupBy(runner.event_window("ts", length), kind.alias("operation"))
        .agg(
            F.count("*").alias("requests"), F.count_if(kind == "error").alias("errors"),
            F.count_if(kind == "purchase").alias("predictions"),
        )
        .select(runner.window_start().alias("window_start"), "operation", "requests", "errors", "predictions")
    )


def error_rates(requests: DataFrame, length: str = "5 minutes", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Share of errors per sliding window."""
    return (
        runner.timed(requests, "ts", late)
        .groupBy(runner.event_window("ts", length, slide))
        .agg(F.count("*").alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors"))
        .select(runner.window_start().alias("window_start"), "requests", "errors", (F.col("errors") / F.col("requests")).alias("error_rate"))
    )


def duration_counts(requests: DataFrame, duration: Column, length: str = "5 minutes", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Requests per duration and sliding window; state holds one count per live pair."""
    return (
        runner.timed(requests, "ts", late)
        .groupBy(runner.event_window("ts", length, slide), duration.alias("duration"))
        .agg(F.count("*").alias("n"))
        .select(runner.window_start().alias("window_start"), "duration", "n")
    )


def slow_windows(counts: DataFrame, percent: int = 95) -> DataFrame:
    """Exact 95th percentile of the duration per window, from merged counts."""
    requests = counts.groupBy("window_start").agg(F.sum("n").alias("requests"))
    known = counts.where("duration IS NOT NULL").select("window_start", F.col("duration").alias("_v"), F.col("n").alias("_c"))
    ranked = nearest_rank(range_segments(known, ["window_start", "_v"]), percent, ["window_start"], "p95")
    return requests.join(ranked, "window_start", "left").select("window_start", "p95", "requests")


def _spaced(keys: list[str], ts: str, columns: list[str], gap: int):
    """Rows of sorted Arrow batches that come more than ``gap`` microseconds after the last kept one of their key.

    A task goes through its rows once: a batch and the last kept time are all it holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, last = None, None  # key and last kept time of the row before
        for batch in batches:
            if not batch.num_rows:
                continue
            named = [batch[k] for k in keys]
            same = np.ones(batch.num_rows, bool)
            for values in named:
                earlier, later = values[:-1], values[1:]
                none = pc.and_(pc.is_null(earlier), pc.is_null(later))
                same[1:] &= pc.or_(pc.fill_null(pc.equal(earlier, later), False), none).to_numpy(zero_copy_only=False)
            same[0] = tuple(v[0].as_py() for v in named) == before
            times = batch[ts].cast(pa.timestamp("us")).to_numpy(zero_copy_only=False).astype("int64").tolist()
            kept = []
            for i, (goes_on, asked, t) in enumerate(zip(same.tolist(), batch["_asked"].to_pylist(), times)):
                if not goes_on:
                    last = None
                if not asked:
                    last = t
                elif last is None or t > last + gap:
                    last = t
                    kept.append(i)
            before = tuple(v[-1].as_py() for v in named)
            yield batch.select(columns).take(pa.array(kept, pa.int64()))

    return run


def suppress_repeats(
    requests: DataFrame, keys: list[str], ts: str, tie: str, out: str, checkpoint: str, within: str = "5 minutes", late: str = "10 minutes"
) -> None:
    """Drop a request that comes within a span of the last kept one of its key.

    The state is a table of the last kept time by key, a generation a micro-batch. Its rows go
    first among those of their key, and the rows of a task are gone through in order. A batch
    reads the generation before its own, so a replay comes to the same. Rows older than the
    newest time of earlier batches by more than ``late`` are dropped, and a key leaves the
    state once no row that is still let in could repeat its last one.
    """
    spark, state = requests.sparkSession, f"{out}-state"
    gap, wait = pd.Timedelta(within) // pd.Timedelta(microseconds=1), F.expr(f"INTERVAL {late}")

    def step(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn(ts, F.col(ts).cast("timestamp")).where(F.col(ts).isNotNull())
        columns, kind = rows.columns, rows.schema
        newest, asked = rows.agg(F.max(ts)), rows.withColumn("_asked", F.lit(True))
        held = None
        if batch_id:
            held = spark.read.parquet(f"{state}/batch_id={batch_id - 1}")
            seen = held.agg(F.max("_newest")).scalar()
            newest = newest.unionByName(held.agg(F.max("_newest").alias(newest.columns[0])))
            asked = asked.where(F.coalesce(F.col(ts) > seen - wait, F.lit(True)))
            asked = asked.unionByName(held.select(*keys, ts, F.lit(False).alias("_asked")), allowMissingColumns=True)
        ordered = asked.repartition(*keys).sortWithinPartitions(*keys, "_asked", ts, tie)
        ordered.mapInArrow(_spaced(keys, ts, columns, gap), kind).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        kept = spark.read.schema(kind).parquet(f"{out}/batch_id={batch_id}").select(*keys, ts)
        newest = newest.agg(F.max(newest.columns[0])).scalar()
        latest = (kept if held is None else kept.unionByName(held.select(*keys, ts))).groupBy(*keys).agg(F.max(ts).alias(ts))
        live = latest.withColumn("_newest", newest).where(F.col(ts) + F.expr(f"INTERVAL {within}") > F.col("_newest") - wait)
        live.write.mode("overwrite").parquet(f"{state}/batch_id={batch_id}")
        runner.forget(spark, f"{state}/batch_id={batch_id - 2}")

    runner.run_available(requests, checkpoint, step)


def keep_latest(features: DataFrame, key: str, order: list[str], days: int, out: str, checkpoint: str) -> None:
    """Newest row per entity, dropped once it is older than the time to live.

    A micro-batch touches the buckets of its own entities only, in a keyed table with
    versions; a replayed batch finds its tag committed and does nothing. The newest time
    seen is noted with each version. Expired rows are hidden by it at once and leave the
    files when their bucket is next rewritten.
    """
    spark, ts = features.sparkSession, order[0]

    def step(batch: DataFrame, batch_id: int) -> None:
        table = KeyedTable(spark, out)
        if not table.versions():
            create(batch.limit(0), out, [key], order)
        seen = table.commit()["note"].get("newest")
        newest = batch.agg(F.max(F.greatest(ts, F.lit(seen).cast(batch.schema[ts].dataType))).cast("string")).first()[0] or seen

        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            latest = first_per_key(old.unionByName(new), [key], [F.col(c) for c in order])
            return unexpired(latest, ts, F.lit(newest).cast(batch.schema[ts].dataType), days)

        table.change(batch, merge, f"{checkpoint}#{batch_id}", {"newest": newest, "ts": ts, "days": days}).forget()

    runner.run_available(features, checkpoint, step)


def unexpired(features: DataFrame, ts: str, as_of: Column, days: int = 7) -> DataFrame:
    return features.where(F.col(ts) >= as_of - F.make_dt_interval(F.lit(days)))


def session_activity(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conv_id").agg(
        F.max("created_at").alias("last_activity"), F.count("*").alias("total_messages"),
        F.count_if(F.col("role") == "user").alias("user_messages"),
    )


def gain_sums(gains: DataFrame, step: str) -> DataFrame:
    """Sum and count of the gains per metric and step."""
    return gains.groupBy("metric", step).agg(F.sum("value").alias("total"), F.count("value").alias("n"))


def smoothed_by_step(sums: DataFrame, step: str) -> DataFrame:
    """Weights after one smoothing step per value of ``step``, in its order.

    Steps are a column of the data (a day, a nightly run), so the weights do not
    depend on how rows were cut into micro-batches. A metric has one row per step.
    """
    gain = F.try_divide("total", "n") / 100
    steps = sums.where("n > 0").groupBy("metric").agg(F.sort_array(F.collect_list(F.struct(F.col(step), gain.alias("gain")))).alias("_steps"))
    folded = F.aggregate("_steps", F.lit(weights.DEFAULT_WEIGHT), lambda old, s: weights.smoothed_value(old, s["gain"]))
    return steps.select(F.col("metric").alias("metric_slug"), folded.alias("weight_value"))


def newest_generation(spark: SparkSession, out: str) -> DataFrame:
    """Live rows of the table that ``keep_latest`` maintains."""
    table = KeyedTable(spark, out)
    rows, note = table.read(), table.commit()["note"]
    return unexpired(rows, note["ts"], F.lit(note["newest"]).cast(rows.schema[note["ts"]].dataType), note["days"]) if note.get("newest") else rows


def daily_counts(events: DataFrame, ttl: str = "7 days") -> DataFrame:
    """Rows per day; rows older than the time to live are ignored."""
    return (
        runner.timed(events, "ts", ttl).groupBy(runner.event_window("ts", "1 day")).agg(F.count("*").alias("n"))
        .select(runner.window_start().alias("day"), "n")
    )


def fresh_rows(events: DataFrame, ttl: str = "7 days") -> DataFrame:
    """Each event once, unless it is older than the time to live.

    Rows reach the state one by one, so the query's progress counts each late row.
    """
    return runner.timed(events, "ts", ttl).dropDuplicatesWithinWatermark(["event_id"])


def dimension_scores(scores: DataFrame) -> DataFrame:
    """Latest score, spread of durations and error count per dimension."""
    return scores.groupBy("dimension").agg(
        F.max_by("score", F.struct("ts", "event_id")).alias("latest_score"), F.max("ts").alias("measured_at"),
        F.count("*").alias("measurements"),
    )
