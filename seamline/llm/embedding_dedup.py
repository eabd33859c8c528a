"""Near-dedup of embeddings by random hyperplane signs, exact cosine and connected components.

Vectors of one label are compared when they fall on the same sides of ``BITS``
random hyperplanes in one of ``TABLES`` tables; two vectors at cosine 0.93 miss all
tables with probability 4e-7. In a bucket all cosines are taken in double
precision, block by block. A pair counts in the first table where it meets, so
links are counted once and no pair leaves a task: a task gives sums of links and
the edges of a spanning forest.

Equal vectors of one label form a class, which is compared once and weighs as
many links as it has members. A bucket of more than ``BLOCK`` classes is dealt to
tasks by pairs of blocks, so no task holds a hot bucket.

Vectors that are null, zero or hold null or non-finite components, and those of
a null label, link with nothing: no links, a component of their own, kept. Lengths
are never mixed. Null ids are kept; a component's id is its smallest id that is
not null. A repeated row is another vector. Further columns are never read. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm import common as C

BITS, TABLES, LEAST, BLOCK, SEED = 8, 33, 0.93, 2048, 20_011


def _tabled(bits: int, tables: int):
    """(rep, label, mult, embedding) to a row for each table: group, table key, rep, mult, vector, signs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits)
        for batch in batches:
            rep, label, mult = (batch.column(k).to_numpy() for k in range(3))
            vectors = batch.column(3)
            lengths = np.array([len(v) for v in vectors])
            for size in np.unique(lengths):
                at = np.flatnonzero(lengths == size)
                flat = np.array(vectors.take(pa.array(at)).flatten().to_numpy(), np.float64).reshape(len(at), size)
                if size not in planes:
                    planes[size] = np.random.default_rng([SEED, int(size)]).standard_normal((size, bits * tables))
                signs = ((flat @ planes[size]) > 0).reshape(len(at), tables, bits) @ weights
                raw = [v.tobytes() for v in flat.astype(np.float32 if vectors.type.value_type == pa.float32() else np.float64)]
                signed = [s.tobytes() for s in signs.astype(np.uint32)]
                for t in range(tables):
                    yield pa.record_batch(
                        [pa.array(label[at].astype(np.int64)), pa.array(np.full(len(at), size, np.int32)), pa.array((t << bits) + signs[:, t].astype(np.int64)),
                         pa.array(rep[at]), pa.array(mult[at]), pa.array(raw, pa.binary()), pa.array(signed, pa.binary())],
                        names=["label", "size", "key", "rep", "mult", "vector", "signs"],
                    )

    return run


def _joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give linked places their smallest label, in place."""
    while True:
        x, y = labels[a], labels[b]
        open_ = x != y
        if not open_.any():
            return
        a, b = a[open_], b[open_]
        low = np.minimum(x[open_], y[open_])
        np.minimum.at(labels, x[open_], low)
        np.minimum.at(labels, y[open_], low)
        while True:
            jump = labels[labels]
            if (jump == labels).all():
                break
            labels[:] = jump


def _compared(group: dict, table: int, least: float, single: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links of each member that count in this table, and the member it is joined to."""
    x, signs, mult, block = group["x"], group["signs"], group["mult"], group["block"]
    n = len(x)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    unit = x / norm[:, None]
    links, label = np.zeros(n, np.int64), np.arange(n)
    one = np.arange(n) if single else np.flatnonzero(block == block.min())
    two = one if single else np.flatnonzero(block != block.min())
    for i in range(0, len(one), 256):
        rows = one[i : i + 256]
        near = unit[rows] @ unit[two].T
        a, b = np.nonzero(near >= least - 1e-9)
        value = near[a, b]
        a, b = rows[a], two[b]
        close = np.flatnonzero(np.abs(value - least) <= 1e-9)
        if len(close):
            value[close] = np.einsum("ij,ij->i", x[a[close]], x[b[close]]) / (norm[a[close]] * norm[b[close]])
        good = (value >= least) & ((a < b) if single else True)
        a, b = a[good], b[good]
        for k in range(0, len(a), 200_000):
            c, d = a[k : k + 200_000], b[k : k + 200_000]
            new = (signs[c] == signs[d]).argmax(axis=1) == table
            np.add.at(links, c[new], mult[d[new]])
            np.add.at(links, d[new], mult[c[new]])
        _joined(label, a, b)
    return links, label


def _linked(bits: int, least: float):
    """Rows of buckets, sorted, to rows (rep, links, root)."""

    def close(rows: list[pa.RecordBatch]):
        t = pa.Table.from_batches(rows).combine_chunks()
        kind = np.float32 if t["size"][0].as_py() * 4 == len(t["vector"][0].as_py()) else np.float64
        group = {
            "x": np.frombuffer(b"".join(t["vector"].to_pylist()), kind).reshape(t.num_rows, -1).astype(np.float64),
            "signs": np.frombuffer(b"".join(t["signs"].to_pylist()), np.uint32).reshape(t.num_rows, -1),
            "mult": t["mult"].to_numpy(), "block": t["own"].to_numpy(),
        }
        first = t["first"][0].as_py()
        if first != t["second"][0].as_py() and len(np.unique(group["block"])) < 2:
            return
        links, label = _compared(group, t["key"][0].as_py() >> bits, least, first == t["second"][0].as_py())
        rep = t["rep"].to_numpy()
        say = np.flatnonzero((links > 0) | (label != np.arange(len(label))))
        if len(say):
            yield pa.record_batch([pa.array(rep[say]), pa.array(links[say]), pa.array(rep[label[say]])], names=["rep", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(5))))
            start = 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[start]:
                    if rows and keys[start] != now:
                        yield from close(rows)
                        rows = []
                    now = keys[start]
                    rows.append(batch.slice(start, i - start))
                    start = i
        if rows:
            yield from close(rows)

    return run


def groups(vectors: DataFrame, least: float = LEAST, bits: int = BITS, tables: int = TABLES, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors``."""
    rows = vectors.select(F.monotonically_increasing_id().alias("_row"), "vec_id", "label", "embedding")
    fit = F.expr(
        "label IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(embedding, x -> x <> 0)"
    )
    fit = F.coalesce(fit, F.lit(False))
    # Grouping equal vectors combines before the shuffle, so a hot vector is no hot key.
    classes = C.cut_lineage(rows.where(fit).groupBy("label", "embedding").agg(F.min("_row").alias("rep"), F.count("*").alias("mult"), F.min("vec_id").alias("least")))
    # Labels of any type become numbers for the tasks; the key of a bucket has no other use.
    numbered = classes.select("rep", (F.col("label").cast("long") if dict(classes.dtypes)["label"] in ("int", "bigint", "smallint", "tinyint") else F.xxhash64("label")).alias("label"), "mult", "embedding")
    tabled = numbered.mapInArrow(_tabled(bits, tables), "label long, size int, key long, rep long, mult long, vector binary, signs binary")

    # Sizes of buckets, from the keys alone: the count combines before the shuffle.
    sizes = tabled.groupBy("label", "size", "key").agg(F.count("*").alias("bucket")).where("bucket > 1")
    sized = tabled.join(sizes, ["label", "size", "key"])
    blocks = F.ceil(F.col("bucket") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    dealt = sized.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("label", "size", "key", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), "own", "rep", "mult", "vector", "signs")
    keys = ["label", "size", "key", "first", "second"]
    n = C.partitions(vectors.sparkSession)
    found = C.cut_lineage(dealt.repartition(n, *keys).sortWithinPartitions(*keys, "rep").mapInArrow(_linked(bits, least), "rep long, links long, root long"))

    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    component = C.components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    known = classes.join(links, "rep", "left").join(component, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    smallest = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(smallest, "component").select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "component_id", F.lit(True).alias("known"))
    out = rows.withColumn("fit", fit).join(known, (rows["label"] == known["label"]) & (rows["embedding"] == known["embedding"]) & F.col("fit"), "left")
    component_id = F.when(F.col("known"), F.col("component_id")).otherwise(rows["vec_id"])
    return out.select(
        rows["vec_id"], F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), rows["vec_id"].eqNullSafe(component_id).alias("kept")
    )
