"""Every query and stage runs over whole small tables."""

import duckdb

import corpus_pipeline
from seamline.llm.queries import QUERIES


def test_there_is_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_queries_answer_for_each_row(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name in ("op1_suffix_array_dedup", "op3_toxicity", "op4_language_id", "op5_substring_dedup", "op6_lm_scoring", "op7_minhash_near_dedup"):
        assert QUERIES[name](spark, sf).count() == docs, name
    assert QUERIES["op2_embedding_near_dedup"](spark, sf).count() == spark.read.parquet(f"{sf}/embeddings.parquet").count()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op4_language_id"](spark, sf).toPandas()  # noqa: F841 - duckdb reads it
    right, all_ = duckdb.sql(f"SELECT count(*) FILTER (lang = lang_pred), count(*) FROM rows JOIN '{sf}/documents.parquet' USING (doc_id) WHERE held_out").fetchall()[0]
    assert right >= 0.95 * all_ > 0
    rows = QUERIES["op3_toxicity"](spark, sf).toPandas()  # noqa: F841
    right, all_ = duckdb.sql(f"SELECT count(*) FILTER (toxic = predicted), count(*) FROM rows JOIN '{sf}/labels.parquet' USING (doc_id) WHERE held_out").fetchall()[0]
    assert right >= 0.9 * all_ > 0
    rows = QUERIES["op6_lm_scoring"](spark, sf).toPandas()  # noqa: F841
    assert duckdb.sql("SELECT sum(score) > sum(base_score) FROM rows WHERE held_out").fetchall()[0][0]


def test_pipeline_keeps_what_its_operators_keep(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] >= sizes[2] == sizes[3] >= sizes[4] > 0
    assert docs.select("doc_id").distinct().count() == sizes[4]
    tokens = docs.groupBy().sum("length").first()[0]
    assert corpus_pipeline.run(spark, sf).groupBy().sum("length").first()[0] == tokens
