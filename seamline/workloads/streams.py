"""Incremental jobs, run to the end of what has landed and read back.

Data lands in two or more steps with a run after each, so that state, file
tracking and replays across restarts are part of what is compared.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from seamline.functions import dates
from seamline.operators import relational as rel
from seamline.session import scratch
from seamline.sources import feeds
from seamline.streaming import jobs, runner
from seamline.workloads import standins as st
from seamline.workloads.joins import CRAWL_HASH, _hashed
from seamline.workloads.registry import query
from seamline.workloads.sources import ENVELOPE_SQL


class _Run:
    """Folders of one streaming run."""

    def __init__(self, spark, label):
        base = scratch(spark, label)
        self.landing, self.out, self.checkpoint = f"{base}/landing", f"{base}/out", f"{base}/checkpoint"


def _land(df, path):
    df.write.mode("append").parquet(path)


@query("r01_incremental_ingestion", ENVELOPE_SQL)
def incremental_ingestion(spark, sf):
    run = _Run(spark, "ingest")
    responses = st.feed_payloads(spark, sf).withColumn("extracted_at", dates.stamp("2024-01-31 06:00:00"))
    first = F.col("source").isin("IEA", "EIA")
    for part in (responses.where(first), responses.where(~first)):
        part.write.mode("append").json(run.landing)
        jobs.ingest_feeds(spark, run.landing, run.out, run.checkpoint)
    return runner.read_appended(spark, run.out)


def _events_stream(spark, sf, run, columns=("event_id", "ts", "user_id", "event_type", "value")):
    events = st.table(spark, sf, "events").select(*columns)
    _land(events, run.landing)
    return runner.stream_files(spark, run.landing, events.schema)


@query("r02_request_counts", """
SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, event_type AS operation, count(*) AS requests,
  count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'purchase') AS predictions FROM events GROUP BY 1, 2
""")
def request_counts(spark, sf):
    run = _Run(spark, "counts")
    runner.update_all(jobs.request_counts(_events_stream(spark, sf, run)), run.out, run.checkpoint)
    return runner.read_latest(spark, run.out, ["window_start", "operation"])


SLIDES_SQL = """slid AS (SELECT time_bucket(INTERVAL 1 MINUTE, ts) - to_minutes(CAST(i AS BIGINT)) AS window_start, event_type, value FROM events, range(5) t(i))"""


@query("r03_error_rate_alerts", f"""WITH {SLIDES_SQL}
SELECT window_start, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS error_rate
FROM slid GROUP BY 1 HAVING count(*) FILTER (event_type = 'error') / count(*) > 0.05
""")
def error_rate_alerts(spark, sf):
    run = _Run(spark, "errors")
    runner.update_all(jobs.error_rates(_events_stream(spark, sf, run)), run.out, run.checkpoint)
    return runner.read_latest(spark, run.out, ["window_start"]).where("error_rate > 0.05")


def slow(spark, events, cuts):
    """95th percentiles of all windows; a batch lands for each part between ``cuts`` of time."""
    run = _Run(spark, "slow")
    edges = [None, *cuts, None]
    for since, until in zip(edges[:-1], edges[1:]):
        part = events if since is None else events.where(F.col("ts") >= since)
        _land(part if until is None else part.where(F.col("ts") < until), run.landing)
        stream = jobs.duration_counts(runner.stream_files(spark, run.landing, events.schema), F.col("value") / 1000)
        runner.update_all(stream, run.out, run.checkpoint)
    return jobs.slow_windows(runner.read_latest(spark, run.out, ["window_start", "duration"]))


@query("r04_slow_windows", f"""WITH {SLIDES_SQL}
SELECT window_start, round(quantile_disc(value / 1000, 0.95), 6) AS p95, count(*) AS requests FROM slid GROUP BY 1 HAVING quantile_disc(value / 1000, 0.95) > 0.1
""")
def slow_windows(spark, sf):
    run = _Run(spark, "slow")
    events = st.table(spark, sf, "events").select("ts", "value")
    return slow(spark, events, [dates.stamp("2024-01-10"), dates.stamp("2024-01-20")]).where("p95 > 0.1")


@query("r05_keyed_change_detection", f"""
WITH a AS (SELECT concat(name, country) AS site, {CRAWL_HASH} AS h FROM crawl_previous), b AS (SELECT concat(name, country) AS site, {CRAWL_HASH} AS h FROM crawl_current)
SELECT site, 'new' AS status, h AS content_hash FROM a
UNION ALL SELECT b.site, CASE WHEN a.h IS NULL THEN 'new' ELSE 'updated' END, b.h FROM b LEFT JOIN a ON a.site = b.site WHERE a.h IS NULL OR a.h <> b.h
""")
def keyed_change_detection(spark, sf):
    return detected(spark, [st.crawl_previous(spark, sf), st.crawl_current(spark, sf)], [1, 1])


def detected(spark, snapshots, runs):
    """Changes over crawls in order; ``runs`` says how many crawls land before each run."""
    run = _Run(spark, "changes")
    waiting = list(enumerate(snapshots))
    for many in runs:
        for number, snapshot in waiting[:many]:
            rows = _hashed(snapshot).select(F.concat("name", "country").alias("site"), F.lit(number).cast("long").alias("snapshot"), "content_hash")
            _land(rows, run.landing)
        waiting = waiting[many:]
        stream = jobs.detect_changes(runner.stream_files(spark, run.landing, rows.schema), "site")
        runner.update_all(stream, run.out, run.checkpoint)
    return runner.read_appended(spark, run.out)


REPEATS_SQL = """
WITH RECURSIVE following AS (
  SELECT a.event_id, arg_min(b.event_id, (b.ts, b.event_id)) AS next FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = b.event_type AND b.ts > a.ts + INTERVAL 5 MINUTE GROUP BY 1),
kept AS (
  SELECT arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id, event_type
  UNION ALL SELECT following.next FROM kept JOIN following ON kept.event_id = following.event_id)
SELECT event_id, ts, user_id, event_type, value FROM events WHERE event_id IN (SELECT event_id FROM kept)
"""


def suppressed(spark, events, cuts):
    """Requests that are served anew; a batch lands for each part between ``cuts`` of time."""
    run = _Run(spark, "repeats")
    edges = [None, *cuts, None]
    for since, until in zip(edges[:-1], edges[1:]):
        part = events if since is None else events.where(F.col("ts") >= since)
        _land(part if until is None else part.where(F.col("ts") < until), run.landing)
        stream = runner.stream_files(spark, run.landing, events.schema)
        jobs.suppress_repeats(stream, ["user_id", "event_type"], "ts", "event_id", run.out, run.checkpoint)
    return runner.read_appended(spark, run.out)


@query("r06_repeat_suppression", REPEATS_SQL)
def repeat_suppression(spark, sf):
    events = st.table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return suppressed(spark, events, [dates.stamp("2024-01-10"), dates.stamp("2024-01-20")])


@query("r07_latest_features_with_expiry", """
WITH l AS (SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, max(ts) AS ts, max_by(value, (ts, event_id)) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT * FROM l WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY
""")
def latest_features_with_expiry(spark, sf):
    run = _Run(spark, "latest")
    events = st.table(spark, sf, "events").where("event_type = 'purchase'").select("user_id", "ts", "event_id", "value")
    middle = dates.stamp("2024-01-15")
    for part in (events.where(F.col("ts") < middle), events.where(F.col("ts") >= middle)):
        _land(part, run.landing)
        stream = runner.stream_files(spark, run.landing, events.schema)
        jobs.keep_latest(stream, "user_id", ["ts", "event_id"], 7, run.out, run.checkpoint)
    as_of = rel.latest_value(st.table(spark, sf, "events"), "ts")
    return jobs.unexpired(jobs.newest_generation(spark, run.out), "ts", as_of)


@query("r08_session_activity", """
SELECT conv_id, max(created_at) AS last_activity, count(*) AS total_messages, count(*) FILTER (role = 'user') AS user_messages FROM messages GROUP BY 1
""")
def session_activity(spark, sf):
    run = _Run(spark, "sessions")
    msgs = st.messages(spark, sf).select("conv_id", "turn", "role", "created_at")
    for part in (msgs.where("turn < 2"), msgs.where("turn >= 2")):
        _land(part, run.landing)
        stream = runner.stream_files(spark, run.landing, msgs.schema)
        runner.update_all(jobs.session_activity(stream), run.out, run.checkpoint)
    return runner.read_latest(spark, run.out, ["conv_id"])


@query("r09_smoothed_weights_per_batch", """
WITH g AS (SELECT metric, avg(value) FILTER (entity_id < 700) / 100 AS g1, avg(value) FILTER (entity_id >= 700) / 100 AS g2 FROM component_long GROUP BY 1),
a AS (SELECT metric, g2, greatest(0.1, least(1.0, 0.8 * 0.5 + 0.2 * g1)) AS w1 FROM g)
SELECT metric AS metric_slug, round(greatest(0.1, least(1.0, 0.8 * w1 + 0.2 * g2)), 6) AS weight_value FROM a
""")
def smoothed_weights_per_batch(spark, sf):
    """Two steps; rows of both land in each of two batches."""
    gains = st.component_long(spark, sf).select("entity_id", "metric", "value", F.when(F.col("entity_id") < 700, 1).otherwise(2).alias("step"))
    return smoothed(spark, gains.drop("entity_id"), [gains.where(F.col("entity_id") % 2 == k).drop("entity_id") for k in range(2)])


def smoothed(spark, gains, parts):
    """Weights after the steps of ``gains``, of which one of ``parts`` lands before each run."""
    run = _Run(spark, "smooth")
    for part in parts:
        _land(part, run.landing)
        stream = runner.stream_files(spark, run.landing, gains.schema)
        runner.update_all(jobs.gain_sums(stream, "step"), run.out, run.checkpoint)
    return jobs.smoothed_by_step(runner.read_latest(spark, run.out, ["metric", "step"]), "step")


@query("r10_late_rows_ignored", """
WITH m AS (SELECT max(ts) - INTERVAL 7 DAY AS mark FROM events WHERE event_type <> 'error'),
kept AS (SELECT ts FROM events WHERE event_type <> 'error' UNION ALL SELECT ts FROM events, m WHERE event_type = 'error' AND CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL 1 DAY > mark)
SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(*) AS n FROM kept GROUP BY 1
""")
def late_rows_ignored(spark, sf):
    """Error rows arrive last: those of days already past the watermark are dropped."""
    run = _Run(spark, "late")
    events = st.table(spark, sf, "events").select("ts", "event_type")
    for part in (events.where("event_type <> 'error'"), events.where("event_type = 'error'")):
        _land(part, run.landing)
        stream = runner.stream_files(spark, run.landing, events.schema)
        runner.update_all(jobs.daily_counts(stream), run.out, run.checkpoint)
    return runner.read_latest(spark, run.out, ["day"])


@query("r10_dropped_row_counter", """
WITH m AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 7 DAY AS mark FROM events WHERE event_type <> 'error')
SELECT 0::BIGINT AS landing, count(*) AS read_rows, 0::BIGINT AS late_rows FROM events WHERE event_type <> 'error'
UNION ALL SELECT 1, count(*), count(*) FILTER (ts <= (SELECT mark FROM m)) FROM events WHERE event_type = 'error'
""")
def dropped_row_counter(spark, sf):
    """Rows read and rows dropped as late, by landing, from what the queries reported of their batches."""
    run = _Run(spark, "counter")
    events = st.table(spark, sf, "events").select("event_id", "ts", "event_type")
    for landing, part in enumerate((events.where("event_type <> 'error'"), events.where("event_type = 'error'"))):
        _land(part, run.landing)
        done = runner.append_all(jobs.fresh_rows(runner.stream_files(spark, run.landing, events.schema)), run.out, run.checkpoint)
        runner.keep_progress(spark, done, f"{run.out}-progress/landing={landing}")
    reports = runner.progress(spark, f"{run.out}-progress", ["landing"])
    return reports.groupBy("landing").agg(F.sum("read_rows").alias("read_rows"), F.sum("late_rows").alias("late_rows"))


@query("r11_dimension_scores", """
SELECT event_type AS dimension, round(max_by(value, (ts, event_id)), 6) AS latest_score, max(ts) AS measured_at, count(*) AS measurements FROM events GROUP BY 1
""")
def dimension_scores(spark, sf):
    run = _Run(spark, "dimensions")
    stream = _events_stream(spark, sf, run).select(F.col("event_type").alias("dimension"), F.col("value").alias("score"), "ts", "event_id")
    runner.update_all(jobs.dimension_scores(stream), run.out, run.checkpoint)
    return runner.read_latest(spark, run.out, ["dimension"])
