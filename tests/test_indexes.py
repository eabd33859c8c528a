"""Kept indexes, versioned tables and tree tools against brute force."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.sql import functions as F

from seamline.operators import vectors
from seamline.plans import attribution, models, text_index, tree_search, vector_index
from seamline.session import scratch
from seamline.sources import feeds, keyed_table, sinks


# --- inverted file of vectors -----------------------------------------------------------

def recall(got, x, ids, queries, k):
    """Share of the exact k nearest that were found."""
    hits = 0
    for q in queries:
        exact = np.lexsort((ids, np.linalg.norm(x - x[np.flatnonzero(ids == q)[0]], axis=1)))[:k]
        hits += len(got[q] & set(ids[exact].tolist()))
    return hits / (k * len(queries))


def found(rows):
    out = {}
    for r in rows.collect():
        out.setdefault(r.query_id, set()).add(r.id)
    return out


@pytest.fixture(scope="module")
def clustered(spark):
    """Three thousand vectors round thirty points; one point has a third of them."""
    rng = np.random.default_rng(4)
    centres = rng.normal(scale=4, size=(30, 16))
    which = np.where(np.arange(3000) % 3 == 0, 0, rng.integers(0, 30, 3000))
    x = centres[which] + rng.normal(size=(3000, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(9001, None), (9002, [1.0, float("nan")] * 8), (9003, [1.0]), (9004, [float("inf")] * 16), (9005, [])]
    return spark.createDataFrame(rows + bad, "id bigint, v array<double>").repartition(4), x


def test_index_finds_most_neighbours_and_reads_few_rows(spark, clustered, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK", 20)  # the hot cell is kept in many blocks
    df, x = clustered
    ids = np.arange(len(x))
    first, later = df.where("id % 2 = 0 OR id > 9000"), df.where("id % 2 = 1 AND id < 9000")
    path = scratch(spark, "index")
    index = vector_index.build(first, "id", "v", path, cells=60)
    assert index.rows.count() == 1500 and index.blocks.groupBy("cell").count().agg(F.max("count")).first()[0] > 3
    before = {r.file: r.n for r in index.rows.groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n")).collect()}
    index = vector_index.VectorIndex(spark, path).append(later, "id", "v")
    after = {r.file: r.n for r in index.rows.groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n")).collect()}
    assert before.items() <= after.items() and index.rows.count() == 3000
    asked = df.where("id % 30 = 0 OR id > 9000")
    got = found(index.search(asked, "id", "v", 10))
    assert recall(got, x, ids, [i for i in range(0, 3000, 30)], 10) >= 0.9
    others = df.where("id % 30 = 1")  # away from the hot cell
    assert index.scanned_share(others, "id", "v") < 0.2
    assert recall(found(index.search(others, "id", "v", 10)), x, ids, [i for i in range(1, 3000, 30)], 10) >= 0.9


def test_index_is_exact_when_all_cells_are_probed(spark, clustered, monkeypatch):
    monkeypatch.setattr(vector_index, "QUERY_BLOCK", 7)
    df, x = clustered
    small = df.where("id < 300")
    twice = small.unionByName(small.where("id = 3").withColumn("id", F.lit(5000).cast("long")))  # a tie
    index = vector_index.build(twice, "id", "v", scratch(spark, "index"), cells=9)
    asked = small.where("id < 40")
    rows = index.search(asked, "id", "v", 5, probes=9).collect()
    ids, y = np.append(np.arange(300), 5000), np.vstack([x[:300], x[3:4]])
    for q in range(40):
        gap = np.linalg.norm(y - x[q], axis=1)
        want = np.lexsort((ids, gap))[:5]
        mine = sorted((r.distance, r.id) for r in rows if r.query_id == q)
        assert [i for _, i in mine] == ids[want].tolist()
        assert [d for d, _ in mine] == pytest.approx(gap[want].tolist())


def test_index_of_nothing(spark):
    empty = spark.createDataFrame([(1, None)], "id bigint, v array<double>")
    index = vector_index.build(empty, "id", "v", scratch(spark, "index"))
    assert index.search(empty, "id", "v", 3).count() == 0


def test_recall_on_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    index = vector_index.build(df, "vec_id", "embedding", scratch(spark, "index"))
    asked = df.where("vec_id % 100 = 0")
    got = {}
    for r in index.search(asked, "vec_id", "embedding", 10).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in asked.collect():
        exact = vectors.nearest(df, "embedding", [float(v) for v in q.embedding], 10, "l2", "vec_id").collect()
        hits += len(got[q.vec_id] & {r.vec_id for r in exact})
    assert hits >= 0.9 * 10 * asked.count()


# --- inverted index of texts ------------------------------------------------------------

TEXTS = {
    1: "The cat and the dog", 2: "the dog AND a cat", 3: None, 4: "", 5: "dog dog dog the the", 6: "of the of the of", 7: "cat-and-the-dog; the end",
    **{100 + i: f"the {'dog' if i % 7 == 0 else 'cow'} and so on" for i in range(200)},
}


def test_queries_get_their_cells_in_bounded_slices(spark, monkeypatch):
    """A slice that Python hands on has a bounded number of rows, however many cells a query probes."""
    index = vector_index.VectorIndex(spark, "nowhere")
    index.__dict__["centres"] = np.random.default_rng(3).normal(size=(300, 4))
    monkeypatch.setattr(vector_index, "PROBED", 700)
    queries = [(i, np.random.default_rng(i).normal(size=4)) for i in range(100)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in queries], "_q long, _v array<double>").coalesce(1)
    seen, real = [], type(df).mapInPandas
    monkeypatch.setattr(type(df), "mapInPandas", lambda self, run, schema: (seen.append(run), real(self, run, schema))[1])
    got = index.nearest_cells(df, 300)
    assert got.count() == 100 * 300
    for r in got.where("nth = 0").collect():
        assert r.cell == ((index.centres - queries[r["_q"]][1]) ** 2).sum(axis=1).argmin()
    slices = [len(part) for part in seen[0](iter([df.toPandas()]))]
    assert sum(slices) == 100 * 300 and max(slices) <= 700


def tokens(text):
    return [t for t in "".join(c if "a" <= c <= "z" else " " for c in (text or "").lower()).split(" ") if t]


def test_text_index_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK_DOCS", 16)
    rows = list(TEXTS.items())
    df = spark.createDataFrame(rows, "id bigint, text string").repartition(3)
    index = text_index.build(df.where("id < 150"), "id", "text", scratch(spark, "terms")).add(df.where("id >= 150"), "text", 1)
    for terms in (["the"], ["the", "and", "dog"], ["the", "the", "dog"], ["nowhere", "the"]):
        want = {i: sum(t in terms for t in tokens(x)) for i, x in rows if set(terms) <= set(tokens(x))}
        assert {r.id: r.hits for r in index.match_all(terms).collect()} == want, terms
    for terms in (["the", "dog"], ["and", "the", "dog"], ["dog", "dog"], ["of", "the", "of"], ["dog", "cat"]):
        want = {i: sum(tokens(x)[k : k + len(terms)] == terms for k in range(len(tokens(x)))) for i, x in rows}
        assert {r.id: r.hits for r in index.match_phrase(terms).collect()} == {i: n for i, n in want.items() if n}, terms


def test_text_search_reads_the_folders_of_its_terms(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "id bigint, text string")
    index = text_index.build(df, "id", "text", scratch(spark, "terms"))
    plan = index.match_all(["the", "dog"])._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.split("\n") if "FileScan" in line]
    assert filters and all("PartitionFilters: [folder" in line and "In(term" in line for line in filters)


def test_texts_travel_whole_and_lists_as_two_arrays(spark, monkeypatch):
    """What crosses the first shuffle of a build is a row a text, not a row a word."""
    monkeypatch.setattr(text_index, "BLOCK_DOCS", 16)
    df = spark.createDataFrame(list(TEXTS.items()), "id bigint, text string")
    planned, grouped = [], type(df).groupBy
    monkeypatch.setattr(type(df), "groupBy", lambda self, *cols: (planned.append((self, cols)), grouped(self, *cols))[1])
    index = text_index.build(df, "id", "text", scratch(spark, "terms"))
    monkeypatch.undo()
    found, cols = planned[0]
    plan = grouped(found, *cols).count()._jdf.queryExecution().executedPlan().toString()
    assert cols == ("block", "term") and plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")
    assert dict(index.postings.dtypes)["docs"] == "array<bigint>" and dict(index.postings.dtypes)["places"] == "array<int>"


# --- keyed table ------------------------------------------------------------------------

SCHEMA = "id bigint, name string, v int"


@pytest.fixture
def table(spark):
    rows = [(i, f"n{i}", 1) for i in range(200)] + [(3, "older", 0), (None, "nobody", 1)]
    return keyed_table.create(spark.createDataFrame(rows, SCHEMA), scratch(spark, "keyed"), ["id"], ["v", "name"], buckets=16)


def rows_of(df):
    return {r.id: (r.name, r.v) for r in df.collect()}


def test_changes_rewrite_only_their_buckets(spark, table):
    before = table.commit()["live"]
    stored = rows_of(table.read())
    assert len(stored) == 201 and stored[3] == ("n3", 1)
    table.upsert(spark.createDataFrame([(5, "new", 2), (5, "newest", 3), (5, "newer", 2), (7, "too old", 0), (None, "somebody", 2)], SCHEMA), ["v", "name"])
    after = table.commit()["live"]
    assert 1 <= sum(before[b] != after[b] for b in before) <= 3
    assert rows_of(table.read()) == stored | {5: ("newest", 3), None: ("somebody", 2)}
    assert rows_of(table.read(0)) == stored  # a reader of the first version keeps it
    assert table.read().count() == 201


def test_updates_deletes_and_inserts_take_one_change_a_key(spark, table):
    table.update(spark.createDataFrame([(1, None, 7), (1, "x", 9), (2, None, 5), (999, "unknown", 1)], SCHEMA), ["v"])
    got = rows_of(table.read())
    assert (got[1], got[2]) == (("x", 9), ("n2", 5)) and 999 not in got and table.read().count() == 201
    table.delete(spark.createDataFrame([(1,), (1,), (None,), (12345,)], "id bigint"))
    got = rows_of(table.read())
    assert 1 not in got and None not in got and len(got) == 199
    table.insert_new(spark.createDataFrame([(2, "known", 1), (500, "a", 1), (500, "b", 2)], SCHEMA), ["v"])
    got = rows_of(table.read())
    assert (got[2], got[500]) == (("n2", 5), ("b", 2)) and table.read().count() == 200


def test_a_failed_or_overtaken_write_leaves_the_old_version(spark, table):
    stored = rows_of(table.read())
    change = spark.createDataFrame([(4, "broken", 9)], SCHEMA)
    with pytest.raises(Exception, match="broken on purpose"):
        table.change(change, lambda old, new: old.withColumn("v", F.raise_error(F.lit("broken on purpose")).cast("int")))
    assert table.versions() == [0] and rows_of(table.read()) == stored

    def overtaken(old, new):
        keyed_table.KeyedTable(spark, table.path).upsert(spark.createDataFrame([(8, "first", 5)], SCHEMA), ["v"])
        return old.unionByName(new)

    with pytest.raises(keyed_table.Conflict):
        table.change(change, overtaken)
    assert rows_of(table.read()) == stored | {8: ("first", 5)}


def test_a_tag_counts_once_and_old_files_go(spark, table):
    more = spark.createDataFrame([(4, "batch", 9)], SCHEMA)
    for _ in range(2):
        table.change(more, lambda old, new: old.unionByName(new), tag="batch-1")
    assert table.versions() == [0, 1] and table.read().where("id = 4").count() == 2
    table.upsert(spark.createDataFrame([(4, "one", 10)], SCHEMA), ["v"]).forget(1)
    assert table.versions() == [2] and table.read().count() == 201
    with pytest.raises(keyed_table.Conflict):
        keyed_table.create(more, table.path, ["id"], ["v"])


def test_repeated_keys_do_not_multiply_rows(spark):
    table = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], SCHEMA)
    changes = spark.createDataFrame([(1, "x", 5), (1, "y", 6), (1, None, 7)], SCHEMA)
    assert rows_of(sinks.update_rows(table, changes, "id", ["v"])) == {1: ("a", 7), 2: ("b", 1)}
    assert sinks.update_rows(table, changes, "id", ["v"]).count() == 2
    fresh = spark.createDataFrame([(3, "p", 1), (3, "q", 2), (1, "no", 9)], SCHEMA)
    assert rows_of(sinks.insert_new(table, fresh, ["id"])) == {1: ("a", 1), 2: ("b", 1), 3: ("q", 2)}
    sessions = spark.createDataFrame([(1, {"a": "0", "b": "0"}), (2, None)], "id bigint, context map<string,string>")
    updates = spark.createDataFrame([(1, {"a": "1"}, 1), (1, {"a": "2", "c": "3"}, 2)], "id bigint, context map<string,string>, at int")
    got = {r.id: r.context for r in sinks.merge_context(sessions, updates, "id", "context", ["at"]).collect()}
    assert got == {1: {"a": "2", "b": "0", "c": "3"}, 2: {}}


# --- one pass over responses -------------------------------------------------------------

def test_routed_records_are_those_of_each_source(spark):
    texts = [
        ("IEA", '{"data": [{"country": "A", "year": 2020, "value": 1.5, "unit": "t"}, {"country": "B"}], "status": "ok"}'), ("IEA", '{"status": "x"}'),
        ("IEA", '{"data": []}'), ("IEA", "{broken"), ("IEA", None), ("EIA", '{"response": {"data": [{"period": "2020-01", "seriesId": "s", "value": 3, "units": "u"}]}}'),
        ("EIA", '{"response": {"data": []}}'), ("EIA", '{"response": {}}'), ("WorldBank", '[null, [{"country": {"id": "C"}, "date": "2019", "value": 4.0}]]'),
        ("WorldBank", "[null]"), ("UNComtrade", '{"data": [{"period": "2021", "reporterCode": "7", "tradeValue": 12, "flowCode": "X"}]}'),
        ("IMF", '{"values": {"GDP": {"A": [{"year": 2020, "value": 1.0}, {"year": 2021, "value": 2.0}], "B": []}}}'), ("IMF", '{"values": {}}'), ("IMF", "[]"), ("other", "{}"),
    ]
    df = spark.createDataFrame(texts, "source string, data string")
    by_source = [feeds.uniform_records(df, s) for s in ("IEA", "EIA", "WorldBank", "UNComtrade")]
    imf = feeds.indicator_points(df).selectExpr("source", "country key", "string(year) period", "value", "indicator unit", "string(null) error")
    want = Counter(tuple(r) for part in [*by_source, imf] for r in part.collect())
    routed = feeds.routed(df)
    assert Counter(map(tuple, routed.collect())) == want
    plan = routed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") <= 1 and "Union" not in plan
    assert sorted(r.reason for r in feeds.quarantined(df).collect()) == ["no text", "not JSON"]


# --- trees ------------------------------------------------------------------------------

def subset_value(nodes, at, known, x):
    """Mean of a tree over its training rows that agree with ``x`` on the known inputs."""
    prediction, count, left, right, feature, threshold = nodes[at]
    if left < 0:
        return prediction
    if feature in known:
        return subset_value(nodes, left if x[feature] <= threshold else right, known, x)
    return sum(nodes[c][1] / count * subset_value(nodes, c, known, x) for c in (left, right))


@pytest.mark.parametrize("kind", ["forest", "boosted", "tree"])
def test_shapley_values_equal_the_sum_over_all_subsets(spark, kind):
    rng = np.random.default_rng(9)
    x = rng.random((300, 4))
    rows = [(i, *map(float, v), float(3 * v[0] - v[1] * v[1] + v[0] * v[2])) for i, v in enumerate(x)]
    inputs = ["a", "b", "c", "d"]
    data = models.assembled(spark.createDataFrame(rows, "id int, a double, b double, c double, d double, label double"), inputs)
    estimator = {
        "forest": models.forest("label", trees=3, depth=4), "boosted": GBTRegressor(labelCol="label", maxIter=3, maxDepth=3, seed=1),
        "tree": DecisionTreeRegressor(labelCol="label", maxDepth=5),
    }[kind]
    model = estimator.fit(data)
    trees, weights = attribution.saved_trees(model)
    some = data.where("id < 12")
    predicted = {r.id: r.prediction for r in model.transform(some).collect()}
    got = {}
    for r in attribution.shapley_values(model, some, ["id"], inputs).collect():
        got.setdefault(r.id, {})[r.feature] = r.contribution
        assert r.prediction == pytest.approx(predicted[r.id])
    value = lambda known, row: sum(weights[t] * subset_value(nodes, 0, known, row) for t, nodes in trees.items())
    for i in range(12):
        for f in range(4):
            others, want = [g for g in range(4) if g != f], 0.0
            for size in range(4):
                chance = math.factorial(size) * math.factorial(3 - size) / math.factorial(4)
                want += sum(chance * (value({*s, f}, x[i]) - value(set(s), x[i])) for s in itertools.combinations(others, size))
            assert got[i][inputs[f]] == pytest.approx(want, abs=1e-9)


def grown_alone(bins, y, leaf, depth):
    """Plain recursion over one tree, with the same rule for splits."""
    node = {"value": y.mean()}
    if depth:
        best, width = None, bins.max() + 1
        for f in range(bins.shape[1]):
            for cut in range(width):
                left = bins[:, f] <= cut
                if min(left.sum(), (~left).sum()) >= leaf:
                    gain = y[left].sum() ** 2 / left.sum() + y[~left].sum() ** 2 / (~left).sum() - y.sum() ** 2 / len(y)
                    if best is None or gain > best[0] + 1e-12:
                        best = gain, f, cut
        if best and best[0] > 1e-9 * (1 + y.sum() ** 2 / len(y)):
            left = bins[:, best[1]] <= best[2]
            node |= {"split": best[1:], "left": grown_alone(bins[left], y[left], leaf, depth - 1), "right": grown_alone(bins[~left], y[~left], leaf, depth - 1)}
    return node


def answer(node, row):
    while "split" in node:
        node = node["left"] if row[node["split"][0]] <= node["split"][1] else node["right"]
    return node["value"]


def test_search_grows_the_trees_of_a_plain_recursion(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 6, (400, 2)).astype(float)
    y = x[:, 0] * 2 + np.sin(x[:, 1] * 3) + rng.normal(size=400)
    df = spark.createDataFrame([(i, float(a), float(b), float(t)) for i, ((a, b), t) in enumerate(zip(x, y))] + [(400, None, 1.0, 1.0)], "at int, a double, b double, y double").repartition(3)
    got = tree_search.forest_search(df, ["a", "b"], "y", ["at"], trees=[1, 2], depths=[1, 3], leaf_sizes=[1, 30], splits=3, bootstrap=False).collect()
    assert len(got) == 8 and [r.rmse for r in got] == sorted(r.rmse for r in got)
    bins = x.astype(int)
    for r in got:  # without samples, trees of a forest are alike
        errors = []
        for fold in range(3):
            first = 400 - (3 - fold) * 100
            tree = grown_alone(bins[:first], y[:first], r.leaf_size, r.depth)
            errors.append(np.sqrt(np.mean([(answer(tree, row) - t) ** 2 for row, t in zip(bins[first : first + 100], y[first : first + 100])])))
        assert r.rmse == pytest.approx(np.mean(errors)), (r.depth, r.leaf_size)


def test_search_grows_from_cells_and_not_from_rows(spark):
    """Sums that go to a level's shuffle are as many however many rows share their bins; results are those of the rows."""
    rows = spark.range(6000).select((F.col("id") % 2000).alias("at"), "id", *[(F.col("id") * k % 5).cast("double").alias(c) for k, c in ((1, "a"), (3, "b"))])
    data = rows.withColumn("y", F.col("a") * 2 + F.col("b") + (F.col("id") % 7)).withColumn("_y", F.col("y"))
    bounds = tree_search.thresholds(data, ["a", "b"])
    blocks = tree_search.binned(data, ["a", "b"], bounds).select((F.col("id") % 4).cast("int").alias("block"), F.xxhash64("id").alias("_key"), "_bins", "_y")
    forests = tree_search.Forests(3, [1], 4, 2, True)
    cells = tree_search.training_cells(blocks.repartition(5), forests).collect()
    assert len(cells) == len({(r.fold, tuple(r["_bins"])) for r in cells}) <= 3 * 25
    held = blocks.toPandas()
    for t in range(4):
        w = tree_search.draws(held["_key"].to_numpy(), t)
        for fold in range(3):
            own = held["block"] <= fold
            assert sum(r.sums[t] for r in cells if r.fold == fold) == w[own].sum()
            assert sum(r.sums[4 + t] for r in cells if r.fold == fold) == pytest.approx((w * held["_y"])[own].sum())


def test_samples_of_trees_are_poisson_and_repeatable():
    keys = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 20_000)
    drawn = tree_search.draws(keys, 3)
    assert drawn.mean() == pytest.approx(1.0, abs=0.03) and (drawn == 0).mean() == pytest.approx(math.exp(-1), abs=0.015)
    assert (drawn == tree_search.draws(keys, 3)).all() and (drawn != tree_search.draws(keys, 4)).any()
    assert Counter(drawn.tolist()).keys() <= set(range(12))
