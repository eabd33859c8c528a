"""Inverted-file index of vectors: k-means cells kept as a table, probed cell by cell.

``build`` learns the cells from a bounded sample and writes every row below its cell;
``append`` adds rows to the cells there are, without touching what is written.
``search`` takes the nearest cells of each query, reads those partitions only, and
ranks their rows by exact distance. How many cells a query probes is measured when the
index is built: for some of its own rows the exact neighbours are found, and the number
is taken that reaches the wanted share of them.

A cell may hold any share of all rows. It is kept in blocks of about ``BLOCK`` rows, and
a task holds one block and at most ``QUERY_BLOCK`` queries. The driver and each task hold
the centres, at most ``MOST_CELLS`` of them. Queries are given their cells, and rows theirs, in
slices: a slice has about ``PROBED`` rows with their vectors, or as many as one query probes,
and ``COMPARED`` distances, however many cells there are.

Rows with a null vector, or one that holds a null or non-finite number or has another
length than most, are not indexed and find nothing. Rows that repeat
are found as often as they are there.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.operators.relational import top_per_key
from seamline.session import cut_lineage

MOST_CELLS, SAMPLE_PER_CELL, BLOCK, QUERY_BLOCK, CALIBRATED = 1 << 16, 64, 20_000, 1024, 200
PROBED, COMPARED = 1 << 13, 1 << 20


def usable(vector: Column, size: int | None = None) -> Column:
    """Whether a vector has only finite numbers, and as many as wanted."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    sized = F.size(vector) > 0 if size is None else F.size(vector) == size
    return F.coalesce(vector.isNotNull() & sized & finite, F.lit(False))


@dataclass(frozen=True)
class VectorIndex:
    """An index below ``path``: centres, rows by cell, blocks of the cells, and what was measured."""

    spark: SparkSession
    path: str

    @cached_property
    def meta(self) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/meta").first().value)

    @cached_property
    def centres(self) -> np.ndarray:
        """At most ``MOST_CELLS`` rows."""
        rows = self.spark.read.parquet(f"{self.path}/centres").orderBy("cell").collect()
        return np.array([r.centre for r in rows], np.float64)

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.schema(f"_id {self.meta['key_type']}, _v array<double>, block string, cell int").parquet(f"{self.path}/rows")

    @property
    def blocks(self) -> DataFrame:
        return self.spark.read.schema("cell int, block string, n long").parquet(f"{self.path}/blocks")

    def nearest_cells(self, queries: DataFrame, probes: int) -> DataFrame:
        """``queries`` (_q, _v) with a row for each of the ``probes`` nearest cells, and the cell's rank."""
        held = self.spark.sparkContext.broadcast(self.centres)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            centres = held.value
            step = max(1, min(256, PROBED // max(1, min(probes, len(centres))), COMPARED // len(centres)))
            for batch in batches:
                for i in range(0, len(batch), step):
                    part = batch.iloc[i : i + step]
                    gaps = distances(np.stack(part["_v"].to_numpy()), centres)
                    order = np.argsort(gaps, axis=1, kind="stable")[:, :probes]
                    out = part.loc[part.index.repeat(order.shape[1])]
                    yield out.assign(cell=order.ravel().astype(np.int32), nth=np.tile(np.arange(order.shape[1], dtype=np.int32), len(part)))

        kind = queries.schema["_q"].dataType.simpleString()
        return queries.mapInPandas(run, f"_q {kind}, _v array<double>, cell int, nth int")

    def asked(self, queries: DataFrame, key: str, vector: str) -> DataFrame:
        v = F.col(vector).cast("array<double>")
        return queries.select(F.col(key).alias("_q"), v.alias("_v")).where(usable(F.col("_v"), self.meta["dimensions"]))

    def search(self, queries: DataFrame, query_id: str, vector: str, k: int, probes: int | None = None) -> DataFrame:
        """(query_id, the index's key, distance): the k nearest rows of the probed cells, ties by key."""
        probes = probes or self.meta["probes"]
        asked = self.asked(queries, query_id, vector)
        probed = self.nearest_cells(asked, probes).drop("nth")
        groups = max(1, -(-asked.count() // QUERY_BLOCK))
        wanted = probed.withColumn("_group", F.pmod(F.xxhash64("_q"), F.lit(groups)).cast("int")).join(self.blocks.select("cell", "block"), "cell")
        cells = [r.cell for r in probed.select("cell").distinct().collect()] if probes < len(self.centres) else None  # at most MOST_CELLS
        rows = self.rows if cells is None else self.rows.where(F.col("cell").isin(cells))
        rows = rows.withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))) if groups > 1 else rows.withColumn("_group", F.lit(0))
        on = ["cell", "block", "_group"]
        kinds = asked.schema["_q"].dataType.simpleString(), self.rows.schema["_id"].dataType.simpleString()
        found = rows.groupBy(*on).cogroup(wanted.groupBy(*on)).applyInPandas(_closest(k), f"_q {kinds[0]}, _id {kinds[1]}, distance double")
        best = top_per_key(found, ["_q"], [F.col("distance"), F.col("_id")], k)
        return best.select(F.col("_q").alias("query_id"), F.col("_id").alias(self.meta["key"]), "distance")

    def scanned_share(self, queries: DataFrame, query_id: str, vector: str, probes: int | None = None) -> float:
        """Rows compared, as a share of queries times rows."""
        asked = self.asked(queries, query_id, vector)
        sizes = self.blocks.groupBy("cell").agg(F.sum("n").alias("n"))
        compared = self.nearest_cells(asked, probes or self.meta["probes"]).groupBy("cell").count().join(sizes, "cell").agg(F.sum(F.col("count") * F.col("n"))).first()[0] or 0
        return compared / max(1, asked.count() * (self.blocks.agg(F.sum("n")).first()[0] or 0))

    def append(self, vectors: DataFrame, key: str, vector: str) -> VectorIndex:
        """Add rows to the cells; nothing that is written is read or changed."""
        held, tag = self.spark.sparkContext.broadcast(self.centres), uuid.uuid4().hex

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            centres = held.value
            step = max(1, min(1024, COMPARED // len(centres)))
            for batch in batches:
                for i in range(0, len(batch), step):
                    part = batch.iloc[i : i + step]
                    yield part.assign(cell=distances(np.stack(part["_v"].to_numpy()), centres).argmin(axis=1).astype(np.int32))

        rows = vectors.select(F.col(key).alias("_id"), F.col(vector).cast("array<double>").alias("_v")).where(usable(F.col("_v"), self.meta["dimensions"]))
        placed = cut_lineage(rows.mapInPandas(run, f"_id {rows.schema['_id'].dataType.simpleString()}, _v array<double>, cell int"))
        sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("parts"))  # a row a cell
        dealt = placed.join(F.broadcast(sizes), "cell").withColumn("block", F.concat(F.lit(f"{tag}-"), F.pmod(F.xxhash64("_id", "_v"), F.col("parts")))).drop("parts")
        dealt.repartition("cell", "block").write.partitionBy("cell").mode("append").parquet(f"{self.path}/rows")
        written = self.rows.where(F.col("block").startswith(tag)).groupBy("cell", "block").agg(F.count("*").alias("n"))
        written.write.mode("append").parquet(f"{self.path}/blocks")
        return self


def distances(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Squared distances by one matrix product; good for choosing, not for reporting."""
    return (queries**2).sum(axis=1)[:, None] + (rows**2).sum(axis=1) - 2 * queries @ rows.T


def _closest(k: int):
    """The k nearest rows of one block for each query, by exact distance and then by key."""

    def run(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or asked.empty:
            return pd.DataFrame({"_q": [], "_id": [], "distance": []})
        x, ids = np.stack(rows["_v"].to_numpy()), rows["_id"].to_numpy()
        out = []
        for i in range(0, len(asked), 128):
            part = asked.iloc[i : i + 128]
            q = np.stack(part["_v"].to_numpy())
            rough = distances(q, x)
            # Rounding may swap near ties: all rows within it of the k-th are measured exactly.
            kth = np.partition(rough, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
            slack = 1e-9 * (1 + (q**2).sum(axis=1) + (x**2).sum(axis=1).max())
            for name, one, row, limit in zip(part["_q"], q, rough, kth + slack):
                near = np.flatnonzero(row <= limit)
                exact = np.sqrt(((x[near] - one) ** 2).sum(axis=1))
                best = np.lexsort((ids[near], exact))[:k]
                out.append(pd.DataFrame({"_q": [name] * len(best), "_id": ids[near][best], "distance": exact[best]}))
        return pd.concat(out, ignore_index=True)

    return run


def build(vectors: DataFrame, key: str, vector: str, path: str, cells: int | None = None, k: int = 10, recall: float = 0.98, seed: int = 42) -> VectorIndex:
    """Learn cells, write all rows below them, and measure how many cells to probe for ``recall`` of the k nearest.

    By default there are as many cells as the square root of the rows. They are learned
    from about ``SAMPLE_PER_CELL`` rows each, chosen by the hash of the key.
    """
    spark = vectors.sparkSession
    good = vectors.select(F.col(key), F.col(vector).cast("array<double>").alias(vector)).where(usable(F.col(vector)))
    lengths = good.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
    dimensions = lengths.d if lengths else 0
    good = good.where(F.size(vector) == dimensions)
    n = good.count()
    cells = max(1, min(cells or round(n**0.5), MOST_CELLS, n))
    share = min(1.0, SAMPLE_PER_CELL * cells / max(n, 1))
    sample = good.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 20)) <= share * (1 << 20))
    learned = KMeans(k=cells, maxIter=15, seed=seed).fit(sample.select(array_to_vector(F.col(vector)).alias("features"))).clusterCenters() if n else [np.zeros(0)]
    spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(learned)], "cell int, centre array<double>").write.parquet(f"{path}/centres")
    index = VectorIndex(spark, path)
    meta = {"key": key, "key_type": good.schema[key].dataType.simpleString(), "dimensions": dimensions, "k": k, "recall": recall, "probes": len(learned)}
    index.__dict__["meta"] = meta  # not yet measured: every cell
    index.append(vectors, key, vector)
    if n:
        meta["probes"] = _measured_probes(index, good, key, vector, k, recall, seed)
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/meta")
    return VectorIndex(spark, path)


def _measured_probes(index: VectorIndex, good: DataFrame, key: str, vector: str, k: int, recall: float, seed: int) -> int:
    """Smallest number of cells that holds ``recall`` of the exact neighbours of ``CALIBRATED`` rows."""
    chosen = good.orderBy(F.xxhash64(F.lit(seed + 1), key), key).limit(CALIBRATED)
    some = index.spark.createDataFrame(chosen.collect(), chosen.schema)  # a bounded sample
    cells = len(index.centres)
    exact = index.search(some, key, vector, k, cells).join(index.rows.select(F.col("_id").alias(key), "cell"), key)
    ranks = index.nearest_cells(index.asked(some, key, vector), cells).select(F.col("_q").alias("query_id"), "cell", "nth")
    counts = exact.join(ranks, ["query_id", "cell"]).groupBy("nth").count().orderBy("nth").collect()  # a row a cell
    total, upto = sum(r["count"] for r in counts), 0
    for r in counts:
        upto += r["count"]
        if upto >= recall * total:
            return r["nth"] + 1
    return cells
