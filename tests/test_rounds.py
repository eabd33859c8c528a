"""Output form, batch cuts, pruned scans and spread ties."""

import math
import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401 - registers the queries
from seamline.functions import dates
from seamline.operators import windows as win
from seamline.operators.relational import first_per_key
from seamline.sources.landed import LandedFeed
from seamline.streaming import jobs, runner
from seamline.workloads import standins as st
from seamline.workloads.registry import QUERIES, canonical
from seamline.plans import weights
from seamline.workloads.streams import detected, slow, smoothed, suppressed


def test_output_form_keeps_large_and_odd_doubles(spark):
    values = [1e13, -5e13, 1e18, 123456.1234565, -0.1234567, float("inf"), float("-inf"), float("nan"), None]
    got = [r.v for r in canonical(spark.createDataFrame(list(enumerate(values)), "i long, v double").orderBy("i")).collect()]
    assert got[:7] == [1e13, -5e13, 1e18, 123456.123457, -0.123457, math.inf, -math.inf]
    assert math.isnan(got[7]) and got[8] is None


def test_suppressed_requests_do_not_depend_on_batches(spark, sf):
    rows = [(i, (i * 97) % 4000, f"u{i % 3}") for i in range(400)]
    base = dates.stamp("2024-01-01")
    events = spark.createDataFrame(rows, "event_id long, s long, user_id string").select(
        "event_id", (base + F.make_dt_interval(secs=F.col("s"))).cast("timestamp").alias("ts"), "user_id", F.lit("view").alias("event_type")
    )
    want, last = set(), {}
    for event, s, user in sorted(rows, key=lambda r: (r[1], r[0])):
        if user not in last or s > last[user] + 300:
            want.add(event)
            last[user] = s
    for parts in (1, 3, 10):
        cuts = [(base + F.make_dt_interval(secs=F.lit(4000 * k // parts))).cast("timestamp") for k in range(1, parts)]
        assert {r.event_id for r in suppressed(spark, events, cuts).collect()} == want, parts


def test_suppression_keeps_its_state_in_a_table_of_live_keys(spark, tmp_path):
    """Null keys are a key, late rows repeat nothing, and state holds live keys only."""
    base, out = dates.stamp("2024-01-01"), str(tmp_path / "out")
    landings = [[(0, 0, "a"), (1, 0, None), (2, 299, None), (3, 301, None), (4, 5000, "b")], [(5, 5000, "a"), (6, 4999, "b"), (7, 10, "c"), (8, 5301, "b")]]
    for rows in landings:
        events = spark.createDataFrame(rows, "event_id long, s long, user_id string").select(
            "event_id", (base + F.make_dt_interval(secs=F.col("s"))).cast("timestamp").alias("ts"), "user_id"
        )
        events.write.mode("append").parquet(str(tmp_path / "in"))
        stream = runner.stream_files(spark, str(tmp_path / "in"), events.schema)
        jobs.suppress_repeats(stream, ["user_id"], "ts", "event_id", out, str(tmp_path / "checkpoint"))
        live = {r.user_id for r in spark.read.parquet(f"{out}-state").where("batch_id = 0").collect()}
        assert live == {"b"}
    assert {r.event_id for r in runner.read_appended(spark, out).collect()} == {0, 1, 3, 4, 5, 8}


@pytest.mark.parametrize("name", ["b03_date_range_and_freshness", "p09_historical_features", "p10_online_features"])
def test_dates_reach_the_scan(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts," in plan


@pytest.mark.parametrize("name", ["e02_recent_changes", "g13_most_active_entities"])
def test_days_before_the_latest_reach_the_scan(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"DataFilters: \[isnotnull\(ts#\d+\), \(ts#\d+ >= Subquery", plan)


def test_sorted_curve_spreads_ties(spark):
    df = spark.range(9000).select(F.col("id").alias("i"), F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.col("id") * 1.0).alias("v"))
    out = win.sorted_curve(df, ["i"], "v", "c").orderBy("i").collect()
    assert [r.c for r in out] == sorted(r.v for r in out)


def test_monte_carlo_has_a_row_for_each_entity(spark, sf):
    out = QUERIES["m13_monte_carlo"](spark, sf)
    assert out.count() == st.entity_components(spark, sf).count()
    assert out.where("NOT (p05 <= p25 AND p25 <= p75 AND p75 <= p95)").count() == 0


def test_slow_windows_do_not_depend_on_batches(spark, sf):
    base = dates.stamp("2024-01-01")
    rows = [((i * 97) % 1500, float((i * 31) % 200)) for i in range(300)]
    events = spark.createDataFrame(rows, "s int, value double").select((base + F.make_dt_interval(secs=F.col("s"))).cast("timestamp").alias("ts"), "value")
    want = {}
    for start in range(-240, 1500, 60):
        inside = sorted(v / 1000 for s, v in rows if start <= s < start + 300)
        if inside:
            want[start] = (inside[-(-95 * len(inside) // 100) - 1], len(inside))
    for parts in (1, 3, 10):
        cuts = [(base + F.make_dt_interval(secs=F.lit(1500 * k // parts))).cast("timestamp") for k in range(1, parts)]
        got = slow(spark, events, cuts).withColumn("s", F.timestamp_diff("SECOND", base, "window_start")).collect()
        assert {r.s: (r.p95, r.requests) for r in got} == want, parts


def test_a_backlog_of_crawls_gives_the_same_changes(spark, sf):
    crawls = [st.crawl_previous(spark, sf), st.crawl_current(spark, sf), st.crawl_previous(spark, sf)]
    each, backlog = (sorted(map(tuple, detected(spark, crawls, runs).collect())) for runs in ([1, 1, 1], [3]))
    assert each == backlog and any(status == "updated" for _, status, _ in each)


def test_smoothing_does_not_depend_on_batches(spark):
    rows = [(f"m{i % 3}", float((i * 37) % 100), i % 5) for i in range(200)]
    gains = spark.createDataFrame(rows, "metric string, value double, step int")
    want = {}
    for m in ("m0", "m1", "m2"):
        w = 0.5
        for step in range(5):
            values = [v for n, v, s in rows if n == m and s == step]
            w = max(0.1, min(1.0, 0.8 * w + 0.2 * sum(values) / len(values) / 100))
        want[m] = pytest.approx(w)
    for parts in (1, 3, 10):
        cut = [gains.where(F.pmod(F.xxhash64("value", "step"), F.lit(parts)) == k) for k in range(parts)]
        assert {r.metric_slug: r.weight_value for r in smoothed(spark, gains, cut).collect()} == want, parts


def test_gains_by_feature_move_the_weights_of_their_slugs(spark, sf):
    gains = QUERIES["w08_gain_by_feature"](spark, sf)
    active = spark.createDataFrame([("production_volume", 0.9)], "metric_slug string, weight_value double")
    moved = {r.metric: r for r in weights.smoothed(gains, active).collect()}
    assert moved["production_volume"].old_weight == 0.9 and moved["profitability"].old_weight == 0.5


def test_landed_files_are_read_by_uri(spark, tmp_path):
    spark.dataSource.register(LandedFeed)
    folder = tmp_path / "with space" / "source=IEA"
    folder.mkdir(parents=True)
    (folder / "a.json").write_text('{"country": "DE", "year": 2024, "data": "x"}\n\n{"country": null}')
    for path in (str(tmp_path / "with space"), (tmp_path / "with space").as_uri()):
        rows = spark.read.format("landed_feed").option("path", path).load().collect()
        assert sorted(map(str, rows)) == sorted(map(str, [Row(source="IEA", country="DE", year=2024, data="x"), Row(source="IEA", country=None, year=None, data=None)]))
    with pytest.raises(Exception, match="no .json files below"):
        spark.read.format("landed_feed").option("path", str(tmp_path / "missing")).load().collect()


def test_latest_row_of_fixed_width_needs_no_sort(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 2, None), (2, 9, 1.0)], "k int, t int, v double")
    newest = first_per_key(df, ["k"], [F.col("t")])
    assert sorted(map(tuple, newest.collect())) == [(1, 2, None), (2, 9, 1.0)]
    assert "SortAggregate" not in newest._jdf.queryExecution().executedPlan().toString()


def test_fitted_ensemble_lies_between_its_models(spark, sf):
    odd = "NOT prediction BETWEEN least(forest, boosted, linear) - 1e-6 AND greatest(forest, boosted, linear) + 1e-6"
    assert QUERIES["m06_fitted_ensemble"](spark, sf).where(odd).count() == 0
