"""Distributed orders against brute force, with one key holding most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seamline.operators import segments
from seamline.operators import windows as win


@pytest.fixture(scope="module", autouse=True)
def many_segments(spark):
    """Small inputs would be merged into one segment; the tests want all eight."""
    option = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(option, "false")
    yield
    spark.conf.unset(option)


def test_a_hot_key_spans_segments(hot):
    _, df = hot
    seg = segments.range_segments(df, ["key", "at"])
    assert seg.where("key = 'hot'").select("_seg").distinct().count() > 2
    rows = seg.orderBy("_seg", "_pos").select(F.coalesce("key", F.lit("")).alias("key"), "at").collect()
    assert [tuple(r) for r in rows] == sorted(tuple(r) for r in rows)


@pytest.fixture(scope="module")
def hot(spark):
    rng = np.random.default_rng(7)
    n = 4000
    pdf = pd.DataFrame({
        "key": np.where(rng.random(n) < 0.6, "hot", np.char.add("k", rng.integers(0, 40, n).astype(str))),
        "at": rng.permutation(n),
        "value": np.where(rng.random(n) < 0.5, np.nan, rng.integers(0, 25, n).astype(float)),
    })
    pdf.loc[pdf["key"] == "k3", "key"] = None
    rows = [(k, int(a), None if np.isnan(v) else float(v)) for k, a, v in pdf.itertuples(index=False)]
    return pdf, spark.createDataFrame(rows, "key string, at bigint, value double").repartition(5)


def test_forward_fill_crosses_segments(hot):
    pdf, df = hot
    got = win.forward_fill(df, ["key"], ["at"], "value", "filled").toPandas().sort_values("at")["filled"].tolist()
    ordered = pdf.sort_values("at")
    want = ordered.groupby("key", dropna=False)["value"].ffill().fillna(0).tolist()
    assert got == want


@pytest.mark.parametrize("p", [0.0, 0.25, 0.5, 0.8, 1.0])
def test_percentiles_match_numpy(hot, p):
    pdf, df = hot
    got = segments.exact_percentiles(df, "value", [p], ["key"], ["q"]).toPandas()
    for key, q in got.itertuples(index=False):
        group = pdf[pdf["key"].isna()] if key is None else pdf[pdf["key"] == key]
        assert q == pytest.approx(np.percentile(group["value"].dropna(), p * 100))
    whole = segments.exact_percentiles(df, "value", [p], names=["q"]).first()[0]
    assert whole == pytest.approx(np.percentile(pdf["value"].dropna(), p * 100))


def test_row_numbers_are_dense_and_ordered(hot):
    pdf, df = hot
    got = segments.global_row_number(df, ["key", "at"], "n").toPandas().sort_values("n")
    assert got["n"].tolist() == list(range(1, len(pdf) + 1))
    keys = got["key"].fillna("").tolist()
    assert keys == sorted(keys)


def test_percent_rank_shares_ties(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 2.0, 5.0)] + [("b", 9.0)], "k string, v double")
    got = {(r.k, r.v): r.p for r in win.percent_rank(df, ["k"], "v", "p").collect()}
    assert got == {("a", 1.0): 0.0, ("a", 2.0): pytest.approx(100 / 3), ("a", 5.0): 100.0, ("b", 9.0): 0.0}


def test_as_of_join_respects_time_to_live(spark):
    feats = spark.createDataFrame([("m", "2024-01-01", 1.0), ("m", "2024-01-05", 2.0)], "id string, d string, x double")
    asks = spark.createDataFrame([("m", "2024-01-04"), ("m", "2024-01-05"), ("m", "2024-01-20"), ("m", "2023-12-31"), ("z", "2024-01-04")], "id string, t string")
    feats = feats.select("id", F.col("d").cast("timestamp_ntz").alias("d"), "x")
    asks = asks.select("id", F.col("t").cast("timestamp_ntz").alias("t"))
    rows = segments.as_of_join(asks, feats, "id", "t", "d", ["x"], ttl_days=7).collect()
    got = {(r.id, r.t.strftime("%m-%d")): r.x for r in rows}
    assert got == {("m", "01-04"): 1.0, ("m", "01-05"): 2.0, ("m", "01-20"): None, ("m", "12-31"): None, ("z", "01-04"): None}


def test_expanding_folds_match_the_definition(spark):
    df = spark.range(23).withColumnRenamed("id", "t")
    rows = win.expanding_folds(df, ["t"], 4).collect()
    size = 23 // 5
    for fold in range(4):
        first = 23 - (4 - fold) * size
        assert sorted(r.t for r in rows if r.fold == fold and r.part == "train") == list(range(first))
        assert sorted(r.t for r in rows if r.fold == fold and r.part == "test") == list(range(first, first + size))


def test_codes_by_order_and_by_appearance(spark):
    df = spark.createDataFrame([(3, "b"), (1, "c"), (2, "a"), (4, "c")], "i int, s string")
    assert {r.s: r.c for r in win.label_codes(df, "s", "c").collect()} == {"a": 0, "b": 1, "c": 2}
    assert {r.s: r.c for r in win.appearance_codes(df, "s", "i", "c").collect()} == {"c": 0, "a": 1, "b": 2}
