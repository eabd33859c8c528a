"""Scalar functions on literal and boundary rows."""

import hashlib
import json
import math
import uuid

import pytest
from pyspark.sql import functions as F

from seamline.functions import dates, numeric
from seamline.functions import nested as nx
from seamline.functions import text as tx
from seamline.operators import windows as win
from seamline.plans import retrieval


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()["c"]


def test_names_lose_digits_unless_kept(spark):
    sheet = F.lit("4 Emissions Score")
    assert one(spark, tx.metric_key(sheet, F.lit("co2_intensity"))) == "04_co_intensity"
    assert one(spark, tx.metric_key(sheet, F.lit("co2_intensity"), keep_digits=True)) == "04_co2_intensity"
    assert one(spark, tx.metric_key(F.lit("elsewhere"), F.lit("A b-c!"))) == "00_a_b_c"
    assert one(spark, tx.weight_name(F.lit("04_methane"), F.lit("H10"))) == "w_04_methane_H10"
    assert one(spark, tx.score_name(F.lit("Coal"), F.lit("H10"))) == "s_coal_H10"


def test_name_parsing_gives_null_without_match(spark):
    parsed = one(spark, tx.parse_name(F.lit("w_04_methane_factor_H20"), "weight_column", ["sheet", "slug", "horizon"]))
    assert tuple(parsed) == ("04", "methane_factor", "H20")
    assert one(spark, tx.parse_name(F.lit("w_4_x_H20"), "weight_column", ["sheet", "slug", "horizon"])) is None


@pytest.mark.parametrize("cell, dtype, default, want", [
    ("12 (approx)", "int", None, 12), ("3.7", "int", -1, -1), ("", "double", 0.5, 0.5), (None, "int", 4, 4), (" 2.5 ", "double", None, 2.5),
    ("about", "double", None, None), ("NaN", "double", None, None),
])
def test_safe_numbers(spark, cell, dtype, default, want):
    assert one(spark, tx.safe_number(F.lit(cell), dtype, default)) == want


def test_cleaning_and_markdown(spark):
    clean = one(spark, tx.clean_lines(F.lit("  a   b \n\n  c　\n \t\n")))
    assert clean == "a b\nc"
    got = one(spark, tx.markdown(F.lit("--- Page 1 ---\nplain\nTOTAL\n1.2 Scope\nmore\nend"), F.lit(None), F.lit("x.pdf"), F.lit(2)))
    assert got == (
        "# Document\n\n**Source:** x.pdf\n**Pages:** 2\n\n---\n\n## Page 1\n\nplain\n\n### TOTAL\n\n### 1.2 Scope\n\nmore\nend\n\n"
    )


def test_reference_patterns(spark):
    text = "usgs says R/P Ratio. Learning rate near 12.5% and 3% ; HHI now current 1800"
    found = {r["type"]: r["values"] for r in one(spark, tx.references(F.lit(text)))}
    assert found == {"usgs_data": ["usgs says R/P Ratio"], "learning_rate": ["12.5"], "hhi_current": ["1800"]}


def test_intents_are_tested_in_order(spark):
    ask = lambda t: one(spark, tx.intent(F.lit(t)))
    assert ask("Why change?") == "explain"
    assert ask("WHAT IF coal ends") == "scenario"
    assert ask("top five") == "rank"
    assert ask("hello") == "general"


def test_path_ids_are_version_5(spark):
    for path in ("data/a.pdf", "ünïcode/ß.pdf"):
        assert one(spark, nx.path_uuid(F.lit(path))) == str(uuid.uuid5(uuid.NAMESPACE_DNS, path))


def test_feed_hash_equals_sorted_json_hash(spark):
    record = {"b": 'say "hi"', "a": "x\\y"}
    want = hashlib.sha256(json.dumps(record, sort_keys=True).encode()).hexdigest()[:16]
    assert one(spark, nx.feed_hash(nx.canonical_json({k: F.lit(v) for k, v in record.items()}))) == want


def test_map_merge_prefers_new_values(spark):
    old, new = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3"))
    assert one(spark, nx.merge_maps(old, new)) == {"a": "1", "b": "3"}


def test_confidence_forms_differ(spark):
    cells = [F.lit(v).cast("int") for v in (3, 4, None, 2, 5)]
    assert one(spark, numeric.confidence_seed(*cells)) == pytest.approx(14 / 5)
    assert one(spark, numeric.confidence_trigger(*cells, F.lit(1), F.lit(2), F.lit(None).cast("int"))) == pytest.approx((15 + 4) / 8)
    nine = [F.lit(v).cast("int") for v in (3, 4, None, 2, 1, 5, 1, 0, 2)]
    assert one(spark, numeric.confidence_application(*nine)) == pytest.approx((16 + 3 + 4) / 9)


def test_probability_and_interval(spark):
    assert one(spark, numeric.probability_positive(F.lit(1.959963984540054), F.lit(1.0))) == pytest.approx(0.975)
    places = [k / 8 for k in range(-72, 73)]
    found = spark.createDataFrame([(x,) for x in places], "x double").select("x", numeric.normal_cdf(F.col("x")).alias("p")).collect()
    assert {r.x: r.p for r in found} == pytest.approx({x: (1 + math.erf(x / math.sqrt(2))) / 2 for x in places}, abs=2e-12)
    assert one(spark, numeric.normal_cdf(F.lit(None).cast("double"))) is None
    interval = one(spark, numeric.normal_interval(F.lit(10.0), F.lit(2.0), 0.95))
    assert interval["lower"] == pytest.approx(10 - 3.919928, abs=1e-6)


def test_percent_change_and_bands(spark):
    assert one(spark, numeric.percent_change(F.lit(0.0), F.lit(5.0))) == 0.0
    assert one(spark, numeric.change_magnitude(F.lit(-5.0))) == "moderate"
    assert one(spark, numeric.score_band(F.lit(60.0))) == "moderate"
    assert one(spark, numeric.health_colour(F.lit(64.0), F.lit(80.0))) == "yellow"


def test_iso_rendering(spark):
    assert one(spark, dates.iso_8601(F.lit("2024-01-02 03:04:05").cast("timestamp_ntz"))) == "2024-01-02T03:04:05"
    assert one(spark, dates.iso_8601(F.lit("2024-01-02 03:04:05.5").cast("timestamp_ntz"))) == "2024-01-02T03:04:05.500000"


@pytest.mark.parametrize("n", [0, 1, 462, 463, 512, 513, 1000])
def test_chunks_cover_the_words(spark, n):
    text = " ".join(f"w{i}" for i in range(n))
    chunks = one(spark, retrieval.word_chunks(F.lit(text)))
    words = text.split()
    assert chunks == [" ".join(words[i:i + 512]) for i in range(0, n, 462)]


def column(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")


@pytest.mark.parametrize("values, want", [
    ([], []), ([4.0], [50.0]), ([2.0, 2.0], [50.0, 50.0]), ([0.0, 5.0, 10.0], [0.0, 50.0, 100.0]), ([None, None], [None, None]),
])
def test_min_max_boundaries(spark, values, want):
    rows = win.normalise(column(spark, values), "v", "min_max", "s").orderBy("i").collect()
    assert [r.s for r in rows] == want


@pytest.mark.parametrize("method, want", [("mean", 2.0), ("median", 2.0), ("zero", 0.0)])
def test_fills(spark, method, want):
    rows = win.fill_missing(column(spark, [1.0, None, 3.0]), "v", method, "f").orderBy("i").collect()
    assert [r.f for r in rows] == [1.0, want, 3.0]
    assert win.fill_missing(column(spark, [None]), "v", method, "f").first().f == 0.0


def test_outliers_with_zero_spread(spark):
    flat = column(spark, [5.0] * 9 + [6.0])
    assert [r.v for r in win.outliers(flat, "v", "modified_z_score").collect()] == [6.0]
    assert win.outliers(column(spark, [5.0] * 4), "v", "z_score").count() == 0
    assert [r.v for r in win.outliers(column(spark, [1.0, 2.0, 3.0, 4.0, 100.0]), "v", "iqr").collect()] == [100.0]


def test_sorted_curve_is_not_a_rank(spark):
    rows = win.sorted_curve(column(spark, [3.0, 1.0, 2.0]), ["i"], "v", "c").orderBy("i").collect()
    assert [r.c for r in rows] == [1.0, 2.0, 3.0]


def test_sample_z_scores(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 7.0), ("c", 2.0), ("c", 2.0), ("c", None)], "k string, v double")
    got = sorted((r.k, r.v, r.z) for r in win.z_scores(df, ["k"], "v", "z").collect() if r.v is not None)
    assert got == [("a", 1.0, pytest.approx(-0.7071068)), ("a", 3.0, pytest.approx(0.7071068)), ("b", 7.0, 0.0), ("c", 2.0, 0.0), ("c", 2.0, 0.0)]
