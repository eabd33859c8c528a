"""Near-dedup of documents by SuperMinHash, banding, exact verification and connected components.

A document's set holds its distinct shingles of ``SHINGLE`` words (A-Z lowered),
as 64-bit hashes; a shorter text is one shingle. Documents with the same set form
one class, so copies are never compared. Each element ranks the places of the
signature by a permutation: at step t it offers t plus a fraction to the place
that has rank t. A place that holds a value below t + 1 after step t is final, so a
long document is done after a few steps. Bands of some values each make candidates:
25 of 5 for a threshold of 0.85, 28 of 4 for 0.8 (``BANDING``); two sets at the
threshold miss all bands with probability 4e-7 in both. Candidates count only when
their whole sets meet the threshold.

Candidates that a chain of buckets joins form a coarse group. A task holds the
sets of one coarse group, or of two blocks of a large one, and compares a member
with all others at once; members that are already joined to the same component
are passed over. Only the edges that join components leave a task, so no pair of
a large group is ever a row, and no link between different components is left out.

Null texts and texts without words have an empty set, which links with nothing:
each is its own component. Rows with a null id are compared like others; a
component's id is the smallest id that is not null. A repeated row is a copy.
Further columns are never read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm import common as C
from seamline.session import scratch

SHINGLE = 5
#: Places of a signature: a prime, so that a * t + b runs through all of them.
PLACES = 127
#: Links have 100 * intersection >= percent * union; this is the percent unless another is given.
PERCENT = 85
#: Number of bands and of values in each, by percent.
BANDING = {85: (25, 5), 80: (28, 4)}
#: A task compares blocks of about so many members or shingles at most.
BLOCK_MEMBERS, BLOCK_SHINGLES = 1024, 300_000
#: Members of a group that are compared before its main component is chosen.
FIRST = 8
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the distinct shingles, sorted."""
    data = _LOWER[data]
    starts, ends, row_at = C.words(data, at)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    prefix = C.running(C.word_hashes(data, starts, ends))
    count = np.diff(row_at)
    shingles = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
    row = np.repeat(np.arange(len(count)), shingles)
    first = C.ranges(row_at[:-1], shingles)
    hashes = C.between(prefix, first, first + np.minimum(count, SHINGLE)[row])
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    fresh = np.concatenate([[True], (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])])
    return row[fresh], hashes[fresh]


def super_minhash(row: np.ndarray, hashes: np.ndarray, rows: int) -> np.ndarray:
    """[row, place]: the smallest rank and fraction that an element offers."""
    p = np.uint64(PLACES)
    stride = C.mix(hashes ^ np.uint64(0x5BD1E995)) % (p - np.uint64(1)) + np.uint64(1)
    place = C.mix(hashes ^ np.uint64(0xC2B2AE35)) % p
    best = np.full(rows * PLACES, np.iinfo(np.uint64).max, np.uint64)
    row, hashes = row.astype(np.int64), hashes.copy()
    for t in range(PLACES):
        if not len(row):
            break
        value = (C.mix(hashes + np.uint64(t * int(C.ODD) % (1 << 64))) >> np.uint64(24)) | np.uint64(t << 40)
        np.minimum.at(best, row * PLACES + place.astype(np.int64), value)
        open_ = best.reshape(rows, PLACES).max(axis=1) >= np.uint64((t + 1) << 40)
        go = open_[row]
        if not go.all():
            row, hashes, stride, place = row[go], hashes[go], stride[go], place[go]
        place = (place + stride) % p
    return best.reshape(rows, PLACES)


def band_keys(best: np.ndarray, bands: int, values: int) -> np.ndarray:
    """[row, band]: a hash of the band and its values."""
    out = np.empty((len(best), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(best), np.uint64(b + 1), np.uint64)
        for r in range(values):
            key = C.mix(key ^ C.mix(best[:, b * values + r] + C.ODD))
        out[:, b] = key
    return out


def _signed(bands: int, values: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = C.text_buffer(batch.column(2))
            for i, j in C.slices(at):
                row, hashes = shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i])
                n = np.bincount(row, minlength=j - i)
                total, other = np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)
                np.add.at(total, row, C.mix(hashes))
                np.bitwise_xor.at(other, row, C.mix(hashes + C.ODD))
                keys = band_keys(super_minhash(row, hashes, j - i), bands, values).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands), pa.int32()), pa.array(keys.ravel()))
                yield pa.record_batch(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(total.view(np.int64)), pa.array(other.view(np.int64)), lists],
                    names=["_row", "doc_id", "n", "h1", "h2", "bands"],
                )

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, coarse, blocks, text) to (rep, coarse, blocks, elements): the distinct hashes as bytes."""
    for batch in batches:
        data, at = C.text_buffer(batch.column(3))
        for i, j in C.slices(at):
            row, hashes = shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i])
            cut = np.searchsorted(row, np.arange(j - i + 1))
            out = [hashes[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]
            yield pa.record_batch([*(batch.column(k).slice(i, j - i) for k in range(3)), pa.array(out, pa.binary())], names=["rep", "coarse", "blocks", "elements"])


def spanning_links(sets: list[np.ndarray], split: int, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that join what links of the given sets join.

    With ``split`` 0 all pairs count, otherwise the pairs of the first ``split`` sets
    with the others. A member is marked in the local vocabulary and counted against
    all others at once. One in the main component needs no turn of its own: every
    other member that could be linked to it takes one, or is in that component too.
    """
    n = np.array([len(s) for s in sets])
    at = np.cumsum(n) - n
    vocabulary, ids = np.unique(np.concatenate(sets), return_inverse=True)
    label, main, out = np.arange(len(sets)), None, []
    mark = np.zeros(len(vocabulary), bool)
    other = slice(split, None)
    other_ids, other_at, other_n = ids[at[split] :], at[other] - at[split], n[other]
    for turn, x in enumerate(range(split) if split else range(len(sets))):
        if not split and turn == FIRST:
            main = int(np.argmax(np.bincount(label)[label]))
        if main is not None and label[x] == label[main] or (label[other] == label[x]).all():
            continue
        own = ids[at[x] : at[x] + n[x]]
        mark[own] = True
        common = np.add.reduceat(mark[other_ids], other_at, dtype=np.int64)
        mark[own] = False
        linked = np.flatnonzero((100 * common >= percent * (n[x] + other_n - common)) & (label[other] != label[x])) + split
        if len(linked):
            roots, first = np.unique(label[linked], return_index=True)
            out.extend((x, int(y)) for y in linked[first])
            roots = np.append(roots, label[x])
            label[np.isin(label, roots)] = roots.min()
    return out


def _linked(percent: int):
    """Rows (coarse, first, second, own, rep, elements), sorted, to the edges (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(rows: list[tuple], first: int, second: int):
            split = sum(r[0] == first for r in rows) if first != second else 0
            if len(rows) < 2 or split == len(rows) or first != second and not split:
                return
            found = spanning_links([r[2] for r in rows], split, percent)
            if found:
                yield pa.record_batch([pa.array([rows[x][1] for x, _ in found], pa.int64()), pa.array([rows[y][1] for _, y in found], pa.int64())], names=["a", "b"])

        now, rows = None, []
        for batch in batches:
            for *key, own, rep, elements in zip(*(batch.column(k).to_pylist() for k in range(5)), batch.column(5)):
                if key != now:
                    if rows:
                        yield from close(rows, *now[1:])
                    now, rows = key, []
                rows.append((own, rep, np.frombuffer(elements.as_buffer(), np.uint64)))
        if rows:
            yield from close(rows, *now[1:])

    return run


def groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """_row, doc_id, n_shingles, component_id, kept, first (one row of each component) for each row of ``docs``."""
    spark = docs.sparkSession
    rows = C.with_row(docs, "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"_row long, doc_id {kind}, n long, h1 long, h2 long, bands array<long>"
    path = scratch(spark, "signatures")
    rows.mapInArrow(_signed(*BANDING[percent]), schema).write.parquet(path)
    signed = spark.read.schema(schema).parquet(path)

    chosen = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_row").alias("row"))).alias("chosen")
    classes = signed.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("_row").alias("rep"), F.min("doc_id").alias("least"), chosen)
    classes = C.cut_lineage(classes)
    heads = signed.join(classes.select(F.col("rep").alias("_row")), "_row", "left_semi")
    members = heads.select(F.explode("bands").alias("key"), F.col("_row").alias("rep"))
    # A bucket of one candidate says nothing; the count combines before the shuffle.
    crowded = members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
    members = C.cut_lineage(members.join(crowded, "key"))

    hubs = members.groupBy("key").agg(F.min("rep").alias("hub"))
    coarse = C.components(members.join(hubs, "key").select(F.col("rep").alias("a"), F.col("hub").alias("b"))).toDF("rep", "coarse")
    sized = coarse.join(classes, "rep").groupBy("coarse").agg(F.count("*").alias("size"), F.sum("n").alias("total"))
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK_MEMBERS, F.col("total") / BLOCK_SHINGLES)).cast("int")
    wanted = coarse.join(sized.select("coarse", blocks.alias("blocks")), "coarse")

    texts = rows.select(F.col("_row").alias("rep"), "text").join(wanted.hint("shuffle_hash"), "rep")
    sets = texts.select("rep", "coarse", "blocks", "text").mapInArrow(_sets, "rep long, coarse long, blocks int, elements binary")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = sets.withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    keys = ["coarse", "first", "second"]
    dealt = dealt.select("coarse", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), "own", "rep", "elements")
    dealt = dealt.repartition(C.partitions(spark), *keys).sortWithinPartitions(*keys, "own", "rep")
    links = C.cut_lineage(dealt.mapInArrow(_linked(percent), "a long, b long"))

    # Copies join once, on their class; all else works on one row a class.
    component = C.components(links).toDF("rep", "component")
    of_class = classes.join(component, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = of_class.groupBy("component").agg(F.min("least").alias("component_id"), F.min("chosen").alias("chosen"))
    of_class = of_class.join(least.withColumnRenamed("chosen", "best"), "component").select("n", "h1", "h2", "component_id", F.col("best.row").alias("best"))
    out = signed.select("_row", "doc_id", "n", "h1", "h2").join(of_class, ["n", "h1", "h2"], "left")
    alone = F.col("n") == 0
    component_id = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(
        "_row", "doc_id", F.col("n").alias("n_shingles"), component_id.alias("component_id"),
        F.col("doc_id").eqNullSafe(component_id).alias("kept"), (alone | (F.col("_row") == F.col("best"))).alias("first"),
    )


def digest(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``."""
    return groups(docs, percent).select("doc_id", "n_shingles", "component_id", "kept")


def dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of each group: the one with the smallest id."""
    first = groups(docs, percent).where("first").select("_row")
    numbered = docs.select(F.monotonically_increasing_id().alias("_row"), C.as_struct(docs.columns).alias("_doc"))
    kept = numbered.join(first.hint("shuffle_hash"), "_row", "left_semi")
    return kept.select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns])
