"""Formulas, weights, models, sinks and streams on small literal inputs."""

import statistics

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from seamline import fixed
from seamline.functions import dates
from seamline.operators import aggregates
from seamline.operators import relational as rel
from seamline.operators import vectors
from seamline.plans import features, formulas, models, retrieval, scenarios, weights
from seamline.session import scratch
from seamline.sources import feeds, sinks, tables
from seamline.streaming import jobs, runner


@pytest.fixture(scope="module")
def emissions(spark):
    rows = [(0.8, 0.1, 50.0, 1.0), (0.9, 0.2, 60.0, 1.1), (1.0, 0.3, 70.0, 1.2), (1.1, 0.4, 80.0, 1.3), (1.2, 0.5, 90.0, 1.4)]
    return spark.createDataFrame(rows, "CO2_t_per_MWh double, CH4_emissions_factor double, Carbon_price_USD_per_t double, Emissions_intensity double")


def test_emissions_sheet(emissions):
    got = formulas.sheet_metrics(emissions, "04").orderBy("CO2_t_per_MWh").collect()
    co2 = [0.8, 0.9, 1.0, 1.1, 1.2]
    mean, std = statistics.mean(co2), statistics.stdev(co2)
    assert [r.f_04_co2_intensity for r in got] == pytest.approx([100 * (1 - (x - mean) / std) for x in co2])
    assert got[0].f_04_carbon_cost_exposure == pytest.approx(5000.0)


def test_missing_inputs_give_null_and_others_go_on(emissions):
    row = formulas.all_metrics(emissions).first()
    assert row.f_11_hhi_dominance is None and row.f_04_methane_factor is not None


@pytest.mark.parametrize("text", ["__import__('os')", "a.b", "lambda: 1", "[1]", "a if b else c", "open('x')", "1 +", "abs(x=1)"])
def test_formulas_outside_arithmetic_are_refused(emissions, text):
    assert formulas.user_formula(emissions, text).first().result is None


def test_formula_variables():
    assert formulas.variables("100 * max(b, a) / log1p(a)") == ["b", "a"]


def test_zero_divisors_and_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 0.0, 4.0), (2.0, 2.0, 4.0)], "a double, b double, c double")
    rows = formulas.with_formulas(df, {"r": "a / b", "z": "zscore(c)"}).orderBy("a").collect()
    assert [(r.r, r.z) for r in rows] == [(None, 0.0), (1.0, 0.0)]


@pytest.fixture(scope="module")
def weight_frame(spark):
    rows = [(100.0, 95.0, 80.0, 70.0, 75.0), (90.0, 85.0, 75.0, 65.0, 70.0), (80.0, 75.0, 70.0, 60.0, 65.0), (70.0, 65.0, 65.0, 55.0, 60.0), (60.0, 55.0, 60.0, 50.0, 55.0)]
    names = ["f_04_co2_intensity", "f_04_methane_factor", "f_01_energy_security", "f_20_profit_resilience"]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in [*names, "target"])), names


def test_weights_sum_to_one(spark, weight_frame):
    df, names = weight_frame
    base = spark.createDataFrame([(n, None) for n in names], "metric string, base double")
    combined = weights.combine(base, weights.quality_weights(df, names), weights.information_gain(df, names, "target"), "H10")
    rows = weights.to_unit_sum(combined).collect()
    assert sum(r.weight for r in rows) == pytest.approx(1.0, abs=1e-3)
    assert {r.weight_name for r in rows} == {f"w_{n[2:]}_H10" for n in names}
    # Each feature is a strictly monotone function of the target: all carry the same information.
    assert [r.gain for r in rows] == pytest.approx([1.0] * 4)


def test_gain_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    x, y = rng.random(500), rng.random(500)
    y = y + 2 * x
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "f double, target double").repartition(4)
    got = weights.information_gain(df, ["f"], "target", bins=8).first().raw_gain
    bins = lambda v: np.minimum(np.floor((v - v.min()) / (v.max() - v.min()) * 8), 7).astype(int)
    joint = np.zeros((8, 8))
    np.add.at(joint, (bins(x), bins(y)), 1)
    p = joint / joint.sum()
    outer = p.sum(1, keepdims=True) * p.sum(0, keepdims=True)
    assert got == pytest.approx((p[p > 0] * np.log(p[p > 0] / outer[p > 0])).sum())


def test_quality_weight_of_empty_column_is_zero(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0)], "f_a double, f_b double")
    got = {r.metric: r.quality for r in weights.quality_weights(df, ["f_a", "f_b"]).collect()}
    assert got["f_a"] == 0.0 and got["f_b"] == pytest.approx(0.4 + 0.3 + 0.3 / 1.5)


def test_zero_total_weights_stay(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", 0.0)], "metric string, weight double")
    assert [r.weight for r in weights.to_unit_sum(df).collect()] == [0.0, 0.0]


def test_smoothing_is_clamped(spark):
    gains = spark.createDataFrame([("a", 0.0), ("b", 9.0), ("c", 0.5)], "metric string, gain double")
    active = spark.createDataFrame([("a", 0.01)], "metric_slug string, weight_value double")
    got = {r.metric: r.new_weight for r in weights.smoothed(gains, active).collect()}
    assert got == {"a": 0.1, "b": 1.0, "c": pytest.approx(0.5)}


def test_ensemble_equals_direct_computation(spark):
    rng = np.random.default_rng(1)
    y = rng.normal(size=200)
    a, b = y + rng.normal(scale=0.3, size=200), y + rng.normal(scale=0.9, size=200)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(y, a, b)], "y double, a double, b double")
    rows = {r.model: r for r in models.ensemble(df, "y", ["a", "b"]).collect()}
    rmse = {"a": np.sqrt(np.mean((a - y) ** 2)), "b": np.sqrt(np.mean((b - y) ** 2))}
    inverse = {k: 1 / (v + 1e-6) for k, v in rmse.items()}
    w = {k: v / sum(inverse.values()) for k, v in inverse.items()}
    assert rows["a"].weight == pytest.approx(w["a"])
    assert rows["a"].ensemble_rmse == pytest.approx(np.sqrt(np.mean((w["a"] * a + w["b"] * b - y) ** 2)))


def test_attribution_adds_up(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0), (2, 4.0, 9.0)], "id int, x double, y double")
    rows = models.linear_attribution(df, "id", {"x": 2.0, "y": -1.0}, 5.0).collect()
    for key in (1, 2):
        mine = [r for r in rows if r.id == key]
        assert sum(r.contribution for r in mine) + mine[0].base_value == pytest.approx(mine[0].prediction)


def test_tree_attribution_adds_up(spark):
    rng = np.random.default_rng(9)
    rows = [(i, float(a), float(b), float(3 * a - b * b)) for i, (a, b) in enumerate(rng.random((400, 2)))]
    data = models.assembled(spark.createDataFrame(rows, "id int, a double, b double, label double"), ["a", "b"])
    model = models.forest("label", trees=4, depth=4).fit(data)
    predicted = {r.id: r.prediction for r in model.transform(data).collect()}
    total = {}
    for r in models.tree_attribution(model, data, ["id"], ["a", "b"]).collect():
        total[r.id] = total.get(r.id, r.base_value) + r.contribution
        assert r.prediction == pytest.approx(predicted[r.id])
    assert total == pytest.approx(predicted)


def test_partial_pooling_shrinks_small_groups_more(spark):
    rng = np.random.default_rng(5)
    rows = [("big", float(v)) for v in rng.normal(10, 1, 300)] + [("small", float(v)) for v in rng.normal(14, 1, 4)] + [("mid", float(v)) for v in rng.normal(6, 1, 40)]
    got = {r.g: r for r in models.partial_pooling(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    assert got["small"].shrinkage < got["mid"].shrinkage < got["big"].shrinkage <= 1
    assert min(r.raw_mean for r in got.values()) <= got["small"].pooled_mean <= max(r.raw_mean for r in got.values())


def test_too_few_rows_is_an_error(spark):
    with pytest.raises(ValueError):
        models.require_rows(spark.range(99).toDF("x"))
    assert models.require_rows(spark.range(100).toDF("x")).count() == 100


def test_scenario_clips_only_changed_metrics(spark):
    wide = spark.createDataFrame([{m: 50.0 for m in fixed.COMPONENT_WEIGHTS} | {"emissions_score": 95.0, "economic_score": 130.0}])
    moved = scenarios.shifted({"emissions_score": 20.0})
    row = wide.select(*[c.alias(m) for m, c in moved.items()]).first()
    assert (row.emissions_score, row.economic_score, row.necessity_score) == (100.0, 130.0, 50.0)


def test_draws_are_repeatable_and_spread(spark):
    draws = spark.range(4000).select(scenarios.draw("normal", 1.0, 2.0, F.col("id"), F.lit("m")).alias("x"))
    mean, std = draws.agg(F.avg("x"), F.stddev("x")).first()
    assert mean == pytest.approx(1.0, abs=0.15) and std == pytest.approx(2.0, abs=0.15)
    assert [r.x for r in draws.limit(5).collect()] == [r.x for r in draws.limit(5).collect()]
    with pytest.raises(ValueError):
        scenarios.draw("gamma", 1, 1, F.lit(1))


def test_batch_nearest_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(11)
    corpus, asked = rng.normal(size=(120, 6)), rng.normal(size=(8, 6))
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(corpus)], "id bigint, v array<double>").repartition(4)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "qid bigint, v array<double>")
    got = {}
    for r in vectors.batch_nearest(c, q, 4, "id", "v", "qid", "v").collect():
        got.setdefault(r.query_id, {})[r.rank] = r.id
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = unit(asked) @ unit(corpus).T
    for i in range(8):
        assert [got[i][k] for k in (1, 2, 3, 4)] == np.argsort(-sims[i])[:4].tolist()


def test_approximate_search_finds_the_vector_itself(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(50, 5)))], "id bigint, v array<double>")
    target = df.where("id = 17").first().v
    assert 17 in [r.id for r in retrieval.approximate_nearest(df, "v", target, 3).collect()]


def test_embeddings_have_unit_length(spark):
    df = spark.createDataFrame([("coal mine coal",), ("",)], "t string")
    lengths = [sum(x * x for x in r.embedding) for r in retrieval.embed(df, "t", 64).collect()]
    assert sorted(lengths) == pytest.approx([0.0, 1.0])


def test_export_and_activation_errors(spark):
    df = spark.createDataFrame([("t", "1", True), ("t", "2", False), ("u", "1", True)], "model_type string, model_version string, is_active boolean")
    with pytest.raises(ValueError):
        sinks.export_rows(df, "xml")
    with pytest.raises(LookupError):
        sinks.activate_version(df, "t", "9")
    got = {(r.model_type, r.model_version): r.is_active for r in sinks.activate_version(df, "t", "2").collect()}
    assert got == {("t", "1"): False, ("t", "2"): True, ("u", "1"): True}


def test_date_rewrite_replaces_only_its_days(spark):
    path = scratch(spark, "days")
    rows = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2)], "d string, v int").select(F.col("d").cast("timestamp_ntz").alias("d"), "v")
    at = dates.stamp("2024-02-01")
    sinks.materialise_by_date(rows, path, "d", at)
    sinks.materialise_by_date(rows.where("v = 2").withColumn("v", F.lit(20)), path, "d", at)
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [1, 20]


def test_unreadable_lines_are_quarantined(spark, tmp_path):
    folder = tmp_path / "source=IEA"
    folder.mkdir()
    (folder / "a.json").write_text('{"country": "X", "data": "{\\"status\\": 1}"}\nnot json\n')
    rows = feeds.read_landed(spark, str(tmp_path)).collect()
    assert sorted(r._corrupt_record or "" for r in rows) == ["", "not json"]
    good = [r for r in rows if r._corrupt_record is None][0]
    assert good.source == "IEA" and len(good.provenance_hash) == 16


def test_missing_path_gives_one_error_row(spark):
    df = spark.createDataFrame([("IEA", '{"status": "x"}'), ("IEA", '{"data": [{"country": "A", "value": 1}]}'), ("WorldBank", "[null]")], "source string, data string")
    iea = feeds.uniform_records(df, "IEA").collect()
    assert sorted((r.key or "", r.error or "") for r in iea) == [("", "No data in response"), ("A", "")]
    assert [r.error for r in feeds.uniform_records(df, "WorldBank").collect()] == ["Invalid data format"]


def test_empty_list_has_no_rows_and_broken_text_is_an_error(spark):
    df = spark.createDataFrame([("EIA", '{"response": {"data": []}}'), ("EIA", "{broken")], "source string, data string")
    assert [r.error for r in feeds.uniform_records(df, "EIA").collect()] == ["No data in response"]


def test_types_by_suffix(spark):
    df = spark.createDataFrame([("2024-01-05", "NaN", "x", "7"), ("soon", "2.5", "1e3", "8")], "a_date string, b_value string, c_amount string, d string")
    rows = rel.type_by_suffix(df).orderBy("d").collect()
    assert [(r.a_date and r.a_date.day, r.b_value, r.c_amount, r.d) for r in rows] == [(5, None, None, "7"), (None, 2.5, 1000.0, "8")]


def test_request_plan_size(spark):
    countries = spark.createDataFrame([("A",), ("B",)], "country string")
    years = spark.createDataFrame([(2020,)], "year int")
    n = feeds.request_plan(countries, years).count()
    assert n == 2 * (len(fixed.IEA_DATASETS) + len(fixed.WORLD_BANK_INDICATORS) + len(fixed.IMF_INDICATORS)) + len(fixed.TRADE_CODES)


def test_sheet_rows(spark):
    df = spark.createDataFrame([("METRIC", "Title"), (None, None), ("m1", None), (None, "t2")], "metric string, title string")
    assert tables.body_rows(df, "metric", "title").count() == 2


def test_feature_registry_and_bands(spark):
    registry = features.FeatureRegistry()
    registry.register("twice", F.col("x") * 2)
    df = registry.apply(spark.createDataFrame([(2.0,), (None,)], "x double"))
    banded = features.with_bands(df, {"b": ("x", [1.0, 3.0], ["low", "mid", "high"])})
    assert sorted((str(r.twice), str(r.b)) for r in banded.collect()) == [("4.0", "mid"), ("None", "None")]


def test_smoothing_stream_survives_a_replay(spark):
    base = scratch(spark, "replay")
    for step in (1, 2, None):
        if step:
            spark.createDataFrame([("a", 100.0, step)], "metric string, value double, step int").write.mode("append").parquet(f"{base}/landing")
        stream = runner.stream_files(spark, f"{base}/landing", "metric string, value double, step int")
        runner.update_all(jobs.gain_sums(stream, "step"), f"{base}/out", f"{base}/checkpoint")
    weights = jobs.smoothed_by_step(runner.read_latest(spark, f"{base}/out", ["metric", "step"]), "step")
    assert weights.first().weight_value == pytest.approx(0.8 * (0.8 * 0.5 + 0.2) + 0.2)


def test_expired_entities_leave_the_table(spark):
    base = scratch(spark, "latest")
    schema = "user_id int, ts timestamp_ntz, event_id int, value double"
    steps = [[(1, "2024-01-01", 1, 1.0), (2, "2024-01-06", 2, 2.0)], [(2, "2024-01-04", 3, 9.0), (3, "2024-01-10", 4, 3.0)]]
    for rows in steps:
        df = spark.createDataFrame(rows, "user_id int, ts string, event_id int, value double")
        df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(f"{base}/landing")
        jobs.keep_latest(runner.stream_files(spark, f"{base}/landing", schema), "user_id", ["ts", "event_id"], 7, f"{base}/out", f"{base}/checkpoint")
    assert sorted((r.user_id, r.value) for r in jobs.newest_generation(spark, f"{base}/out").collect()) == [(2, 2.0), (3, 3.0)]


def test_change_stream_ignores_repeats(spark):
    base = scratch(spark, "changes")
    steps = [[("s1", 0, "h1"), ("s2", 0, "h2")], [("s1", 1, "h1")], [("s1", 2, "h9"), ("s3", 2, "h3")]]
    schema = "site string, snapshot long, content_hash string"
    for rows in steps:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/landing")
        stream = jobs.detect_changes(runner.stream_files(spark, f"{base}/landing", schema), "site")
        runner.update_all(stream, f"{base}/out", f"{base}/checkpoint")
    got = sorted((r.site, r.status) for r in runner.read_appended(spark, f"{base}/out").collect())
    assert got == [("s1", "new"), ("s1", "updated"), ("s2", "new"), ("s3", "new")]


def test_linear_search_reads_the_blocks_it_needs(spark, monkeypatch):
    """Errors are those of a fit of each expanding fold, and no fit or measure reads rows it doesn't use."""
    df = spark.range(400).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 7 * 2 + F.col("id") / 100).alias("y"))
    data = models.assembled(df, ["x"])
    read = []
    fit = LinearRegression.fit
    monkeypatch.setattr(LinearRegression, "fit", lambda self, rows, params=None: (read.append(rows), fit(self, rows, params))[1])
    found = models.time_ordered_search(lambda: models.linear("y"), {"regParam": [0.0, 5.0]}, data, ["id"], "y", splits=3)
    plans = [rows._jdf.queryExecution().executedPlan().toString() for rows in read]
    assert len(read) == 6 and all("PartitionFilters: [isnotnull(block" in p for p in plans)
    monkeypatch.undo()
    for r in found:
        errors = []
        for fold in range(3):
            first = 400 - (3 - fold) * 100
            model = models.linear("y").setRegParam(r["regParam"]).fit(data.where(f"id < {first}"))
            rows = model.transform(data.where(f"id >= {first} AND id < {first + 100}")).select("prediction", "y").collect()
            errors.append((sum((q.prediction - q.y) ** 2 for q in rows) / 100) ** 0.5)
        assert r["rmse"] == pytest.approx(sum(errors) / 3)


def test_fits_read_files_in_small_parts(spark, tmp_path):
    """A fit's tasks hold a bounded part of a file; the session's own option is back afterwards."""
    rows = spark.range(3_000_000).select(F.rand(1).alias("x"), F.rand(2).alias("y"), (F.col("id") % 5 == 0).alias("is_validation"))
    rows.coalesce(1).write.option("parquet.block.size", 4 << 20).parquet(str(tmp_path / "rows"))
    data, option = spark.read.parquet(str(tmp_path / "rows")), "spark.sql.files.maxPartitionBytes"
    before, parts = spark.conf.get(option), []

    class Stub:
        def fit(self, train):
            parts.append((spark.conf.get(option), train.rdd.getNumPartitions()))

    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        wide = data.where("NOT is_validation").rdd.getNumPartitions()
        models.fit_on(Stub(), data)
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert parts[0][0] == str(16 << 20) and parts[0][1] > wide == 1 and spark.conf.get(option) == before


def test_summary_groups_in_as_many_tasks_as_it_is_told(spark):
    """Joins aside, all grouping happens in parts dealt by number, and distinct counts copy no cells."""
    values = spark.createDataFrame(
        [(1, "a", "x", 2000, 1.0), (1, "a", "y", 2001, None), (1, None, "x", 1999, 3.0), (2, "b", None, 2000, 0.5)],
        "definition_id long, sub_industry string, country string, year long, normalized_value double",
    )
    definitions = spark.createDataFrame([(i, 7) for i in range(4)], "definition_id long, source_id long")
    sources = spark.createDataFrame([(7, "s")], "source_id long, name string")
    for tasks in (None, 13):
        summary = aggregates.metric_summary(definitions, values, sources, tasks=tasks)
        rows = {r.definition_id: (r.value_count, r.industry_count, r.country_count, r.earliest_year, r.latest_year, r.avg_normalized_value) for r in summary.collect()}
        assert rows == {0: (0, 0, 0, None, None, None), 1: (3, 1, 2, 1999, 2001, 2.0), 2: (1, 1, 0, 2000, 2000, 0.5), 3: (0, 0, 0, None, None, None)}
    plan = summary._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.count(", 13), REPARTITION_BY_NUM") >= 2
