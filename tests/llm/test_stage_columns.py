"""Stages of the pipeline on documents with further columns of awkward names."""

from pyspark.sql import functions as F

import corpus_pipeline

NAMES = ["a.b", "_none", "_row", "_doc", "_rest", "_spans", "a`b", "key", "n", "_cut"]


def test_stages_keep_columns_of_any_name(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    more = docs.select("*", *[F.concat(F.lit(f"{k}:"), F.col("doc_id").cast("string")).alias(c) for k, c in enumerate(NAMES)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, kept = stage(spark, docs, sf), stage(spark, more, sf)
        assert kept.columns == more.columns, name
        rows = kept.collect()
        assert sorted(tuple(r)[: len(docs.columns)] for r in rows) == sorted(map(tuple, plain.collect())), name
        assert all(tuple(r)[len(docs.columns) :] == tuple(f"{k}:{r.doc_id}" for k in range(len(NAMES))) for r in rows), name
