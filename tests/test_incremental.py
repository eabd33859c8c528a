"""The state API, the pluggable source's filters and offsets, progress tables and the versioned online table."""

import time

import pytest
from pyspark.sql import functions as F

from seamline.session import scratch
from seamline.sources.keyed_table import KeyedTable
from seamline.sources.landed import FILTERS, LandedFeed, LandedFile, LandedStream, PrunedReader
from seamline.streaming import changes, jobs, runner

CRAWL = "site string, snapshot long, content_hash string"


def landed(spark, base, rows):
    spark.createDataFrame(rows, CRAWL).coalesce(1).write.mode("append").parquet(f"{base}/landing")


def run(spark, base, **options):
    stream = changes.detect_changes(runner.stream_files(spark, f"{base}/landing", CRAWL), "site", **options)
    runner.update_all(stream, f"{base}/out", f"{base}/checkpoint")
    return sorted(((r.site, r.status, r.content_hash or "") for r in spark.read.parquet(f"{base}/out").collect()), key=str)


def test_detector_goes_on_from_its_state_after_a_restart(spark):
    base = scratch(spark, "detector")
    landed(spark, base, [("a", 0, "x"), ("b", 0, "y"), ("b", 0, "y"), (None, 0, "z")])
    run(spark, base)
    landed(spark, base, [("a", 2, "w"), ("a", 1, "x"), ("b", 1, "y"), ("c", 1, None)])
    run(spark, base)
    landed(spark, base, [("a", 1, "late"), ("a", 3, "w"), ("b", 3, "v"), ("b", 2, "y")])
    got = run(spark, base)
    want = [("a", "new", "x"), ("a", "updated", "w"), ("b", "new", "y"), ("b", "updated", "v"), ("c", "new", ""), (None, "new", "z")]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_detector_forgets_and_reports_silent_keys(spark):
    """Timers need a query that keeps running: it is stopped once they have fired, or after a while."""
    base = scratch(spark, "silent")
    landed(spark, base, [("a", 0, "x")])
    stream = changes.detect_changes(runner.stream_files(spark, f"{base}/landing", CRAWL), "site", forget_after=2000, silent_after=1000)
    with runner.options(spark, runner.STATE_STORE | {"spark.sql.shuffle.partitions": "1"}):
        query = stream.writeStream.foreachBatch(runner.batch_writer(f"{base}/out")).outputMode("update").option("checkpointLocation", f"{base}/checkpoint").trigger(processingTime="1 second").start()

    def until(*wanted):
        for _ in range(40):
            time.sleep(1)
            rows = [(r.site, r.status) for r in spark.read.schema(changes.OUTPUT).parquet(f"{base}/out/*").collect()] if query.lastProgress and query.recentProgress else []
            if all(rows.count(key) >= n for key, n in wanted):
                return True
        return False

    try:
        assert until((("a", "new"), 1), (("a", "silent"), 1))
        landed(spark, base, [("a", 1, "x")])  # forgotten by now: the same content is new again
        assert until((("a", "new"), 2),)
    finally:
        query.stop()


@pytest.fixture
def feed(spark):
    base = scratch(spark, "feed")
    rows = [("IEA", f"c{i}", 2000 + i, "{}") for i in range(6)] + [("EIA", None, 1, "{}"), ("IMF", "q", 2, "{}")]
    spark.createDataFrame(rows, "source string, country string, year long, data string").repartition(2).write.partitionBy("source").json(base)
    spark.dataSource.register(LandedFeed)
    return base


def test_filters_skip_files(spark, feed):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    reader = PrunedReader(feed)
    everything = len(reader.partitions())
    left = list(reader.pushFilters([EqualTo(("source",), "IEA"), GreaterThan(("year",), 2003)]))
    assert left == [GreaterThan(("year",), 2003)]
    assert 0 < len(reader.partitions()) < everything and all("source=IEA" in p.path for p in reader.partitions())
    list(reader.pushFilters([In(("source",), ("IMF", "EIA"))]))
    assert reader.partitions() == []
    with runner.options(spark, FILTERS):
        read = spark.read.format("landed_feed").option("path", feed).option("prune", "true").load()
        rows = read.where("source = 'IEA' AND year > 2003").collect()
        parts = read.where("source = 'IMF'").rdd.getNumPartitions()
    assert sorted(r.year for r in rows) == [2004, 2005]
    assert parts < everything


def test_stream_offsets_take_each_file_once(spark, feed):
    one = LandedStream(feed, 1)
    start, paths = one.initialOffset(), []
    while (end := one.latestOffset()) != start:
        planned = one.partitions(start, end)
        assert len(planned) == 1 and isinstance(planned[0], LandedFile)
        again = LandedStream(feed, 1)  # a restart plans the same files from the offsets alone
        assert [p.path for p in again.partitions(start, end)] == [p.path for p in planned]
        assert again.latestOffset()["last"] >= end["last"]
        paths += [p.path for p in planned]
        one.commit(end)
        start = end
    assert len(paths) == len(set(paths)) == len(LandedStream(feed, 0).files())


def test_progress_counts_late_rows_of_each_landing(spark):
    base = scratch(spark, "late")
    schema = "event_id long, ts timestamp_ntz"
    for number, days in enumerate((["2024-01-01", "2024-01-20"], ["2024-01-02", "2024-01-03", "2024-01-19"])):
        df = spark.createDataFrame([(10 * number + i, d) for i, d in enumerate(days)], "event_id long, ts string")
        df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(f"{base}/landing")
        done = runner.append_all(jobs.fresh_rows(runner.stream_files(spark, f"{base}/landing", schema)), f"{base}/out", f"{base}/checkpoint")
        for _ in range(2):  # a report that is written twice counts once
            runner.keep_progress(spark, done, f"{base}/progress")
    late = {r.batch_id: r.late_rows for r in runner.progress(spark, f"{base}/progress").collect() if r.read_rows}
    assert sorted(late.values()) == [0, 2]
    assert runner.read_appended(spark, f"{base}/out").count() == 3


def test_online_table_rewrites_only_touched_buckets(spark):
    base = scratch(spark, "online")
    schema = "user_id int, ts timestamp_ntz, event_id int"
    for number, rows in enumerate(([(i, "2024-01-05", i) for i in range(200)], [(7, "2024-01-06", 900), (7, "2024-01-04", 901)], [(8, "2024-01-20", 902)])):
        df = spark.createDataFrame(rows, "user_id int, ts string, event_id int").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        df.coalesce(1).write.mode("append").parquet(f"{base}/landing")
        jobs.keep_latest(runner.stream_files(spark, f"{base}/landing", schema), "user_id", ["ts", "event_id"], 7, f"{base}/out", f"{base}/checkpoint")
        table = KeyedTable(spark, f"{base}/out")
        if number == 1:
            live = table.commit()["live"]
            assert sum(live[b] != before[b] for b in live) == 1  # noqa: F821
            assert {r.user_id: r.event_id for r in jobs.newest_generation(spark, f"{base}/out").collect()} == {**{i: i for i in range(200)}, 7: 900}
        before = table.commit()["live"]
    assert [r.user_id for r in jobs.newest_generation(spark, f"{base}/out").collect()] == [8]
    assert table.read().count() > 100  # expired rows stay in untouched buckets, hidden
