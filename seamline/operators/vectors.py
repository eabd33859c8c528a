"""Similarity search over vector columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.operators.relational import top_per_key

QUERY_BLOCK, CORPUS_BLOCK = 2048, 20_000


def centroid(df: DataFrame, vector: str, keys: list[str] | None = None) -> DataFrame:
    """Mean vector (per key), summed map-side into one array per key."""
    mean = Summarizer.mean(array_to_vector(F.col(vector)))
    return df.groupBy(*(keys or [])).agg(vector_to_array(mean).alias("centre"))


def overall_centre(df: DataFrame, vector: str) -> list[float]:
    """Mean vector of a frame on the driver: as many numbers as dimensions."""
    return list(centroid(df, vector).first()["centre"])


def _sum(terms: list[Column]) -> Column:
    """Balanced sum, so that wide vectors do not build a deep expression."""
    while len(terms) > 1:
        paired = [a + b for a, b in zip(terms[::2], terms[1::2])]
        terms = paired + terms[len(paired) * 2:]
    return terms[0]


def _items(vector: Column, n: int) -> list[Column]:
    return [F.get(vector, F.lit(i)).cast("double") for i in range(n)]


def cosine_to(vector: Column, query: list[float]) -> Column:
    """Cosine similarity to a fixed vector, unrolled into generated code."""
    items = _items(vector, len(query))
    norm = math.sqrt(sum(q * q for q in query))
    product = _sum([x * F.lit(float(q)) for x, q in zip(items, query)])
    return F.try_divide(product, F.sqrt(_sum([x * x for x in items])) * F.lit(norm))


def l2_to(vector: Column, query: list[float]) -> Column:
    gaps = [x - F.lit(float(q)) for x, q in zip(_items(vector, len(query)), query)]
    return F.sqrt(_sum([g * g for g in gaps]))


def nearest(df: DataFrame, vector: str, query: list[float], k: int, metric: str, id_column: str) -> DataFrame:
    """Exact k best rows for one query vector.

    ``orderBy().limit()`` keeps k rows per task before the final merge.
    """
    if metric == "l2":
        scored = df.withColumn("distance", l2_to(F.col(vector), query))
        return scored.orderBy("distance", id_column).limit(k)
    scored = df.withColumn("similarity", cosine_to(F.col(vector), query))
    return scored.orderBy(F.col("similarity").desc(), id_column).limit(k)


def batch_nearest(corpus: DataFrame, queries: DataFrame, k: int, id_column: str, vector: str, query_id: str, query_vector: str) -> DataFrame:
    """Exact top-k by cosine for every query.

    Corpus and queries are dealt into blocks of about ``CORPUS_BLOCK`` and
    ``QUERY_BLOCK`` rows by hash. A task holds one block of each, scores them by
    one matrix product and hands on at most k rows per query; nothing goes through
    the driver but the two row counts.
    """
    counts = corpus.agg(F.count("*").alias("n")).union(queries.agg(F.count("*").alias("n"))).collect()
    parts, blocks = (max(1, -(-r.n // size)) for r, size in zip(counts, (CORPUS_BLOCK, QUERY_BLOCK)))
    pair = lambda own, others, name: F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(name)
    vectors = corpus.select(
        F.col(id_column).alias("_id"), F.col(vector).cast("array<double>").alias("_v"),
        F.pmod(F.xxhash64(id_column), F.lit(parts)).cast("int").alias("_part"), pair("_part", blocks, "_block"),
    )
    asked = queries.select(
        F.col(query_id).alias("_q"), F.col(query_vector).cast("array<double>").alias("_v"),
        F.pmod(F.xxhash64(query_id), F.lit(blocks)).cast("int").alias("_block"), pair("_block", parts, "_part"),
    )
    keys = ["_part", "_block"]
    kinds = corpus.select(id_column).schema[0].dataType.simpleString(), queries.select(query_id).schema[0].dataType.simpleString()
    scored = vectors.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(
        _best_pairs(k, id_column), f"query_id {kinds[1]}, {id_column} {kinds[0]}, similarity double"
    )
    return top_per_key(scored, ["query_id"], [F.col("similarity").desc(), F.col(id_column)], k)


def _best_pairs(k: int, id_column: str):
    """The k best of one corpus block for each query of one query block."""

    def unit(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        x = np.stack([np.asarray(v, dtype=np.float64) for v in frame["_v"]])
        norms = np.linalg.norm(x, axis=1)
        keep = norms > 0
        return x[keep] / norms[keep][:, None], keep

    def best(corpus: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], id_column: [], "similarity": []})
        corpus, asked = corpus[corpus["_v"].notna()], asked[asked["_v"].notna()]
        if corpus.empty or asked.empty:
            return none
        (x, there), (q, wanted) = unit(corpus), unit(asked)
        ids, names = corpus["_id"].to_numpy()[there], asked["_q"].to_numpy()[wanted]
        if not len(ids) or not len(names):
            return none
        sims = np.round(q @ x.T, 12)
        order = np.lexsort((np.broadcast_to(ids, sims.shape), -sims), axis=1)[:, :k]
        return pd.DataFrame({
            "query_id": np.repeat(names, order.shape[1]), id_column: ids[order].ravel(),
            "similarity": np.take_along_axis(sims, order, 1).ravel(),
        })

    return best
