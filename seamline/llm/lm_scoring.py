"""Language-model scores from a log-frequency Bloom filter.

One scan turns each Arrow batch of texts into a block: its words as 64-bit hashes,
their training counts, and its documents as numbers of words in the block. Words
are dealt to buckets by hash, counted over all training rows exactly, and go back to
their blocks, so no vocabulary is held whole anywhere. The base score is the sum of
smoothed log probabilities of these exact counts.

Pairs of neighbouring words of each block, held out or not, are dealt to segments by
hash with their training counts, which are added up and quantised to powers of two.
A segment's filter holds (pair, level) for each level up to the pair's: level k is
2 ** (k - 1) occurrences, so a pair seen once has level 1 and an unknown one level 0.
A filter has ``ENTRY_BITS`` bits for each entry, so it grows with the corpus: no level
is left out and its share of false positives is the same at each size. It stays in
the task that filled it: pairs are probed there, level after level, and their levels
go back to their blocks, so no filter is sent to the driver or broadcast. Levels that
the exact count of either word rules out are rejected. A token's probability mixes
its share after the word before it, if the pair is known, with its smoothed share in
the corpus.

Null texts are empty and hold the end alone. Rows with a null id are not held out.
Repeated rows count each time. Without training rows all counts are 0 and each
token has the same probability 1. Further columns are never read. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.llm import common as C
from seamline.session import scratch

#: Bits of the filter for each entry, and probes: one in 100,000 entries that aren't there is found.
ENTRY_BITS, PROBES = 24, 16
LEAST_BITS, LEVELS, MIX = 1024, 40, 0.2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Hash of the end of a text, which also stands before the first word.
END = np.uint64(0x1F83D9ABFB41BD6B)


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token, ends included, and the number of tokens before each row."""
    data = _LOWER[data]
    starts, ends, row_at = C.words(data, at)
    size = np.diff(row_at)
    token_at = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(int(token_at[-1]), END, np.uint64)
    out[C.ranges(token_at[:-1], size)] = C.word_hashes(data, starts, ends)
    return out, token_at


def pairs_of(hashes: np.ndarray, token_at: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it."""
    before = np.concatenate([[END], hashes[:-1]]) if len(hashes) else hashes
    before[token_at[:-1]] = END
    return C.mix(before * C.ODD + hashes)


def segment_count(partitions: int) -> int:
    """A power of two, about four segments a partition, so that segments grow in number and not in size."""
    return 1 << min(16, max(8, (4 * partitions - 1).bit_length()))


def _by_segment(keys: np.ndarray, segments: int) -> Iterator[tuple[int, slice]]:
    """Slices of sorted hashes by their leading bits."""
    cuts = np.searchsorted(keys, np.arange(segments, dtype=np.uint64) << np.uint64(65 - segments.bit_length()))
    cuts = np.append(cuts, len(keys))
    for s in np.flatnonzero(np.diff(cuts)).tolist():
        yield s, slice(int(cuts[s]), int(cuts[s + 1]))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    each, inverse = np.unique(keys, return_inverse=True)
    total = np.zeros(len(each), np.int64)
    np.add.at(total, inverse, counts)
    return each, total


def _blocks(segments: int):
    """(_row, doc_id, held_out, text) to the block of each batch: its documents with all its words, and its words by segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(batches):
            block = (TaskContext.get().partitionId() << 24) | number
            data, at = C.text_buffer(batch.column(3))
            held_out = batch.column(2).to_numpy(zero_copy_only=False)
            hashes, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for i, j in C.slices(at):
                h, token_at = tokens(data[at[i] : at[j]], at[i : j + 1] - at[i])
                hashes.append(h)
                sizes.append(np.diff(token_at))
            flat, size = np.concatenate(hashes), np.concatenate(sizes)
            words, ids, times = np.unique(flat, return_inverse=True, return_counts=True)
            learned = np.bincount(ids[np.repeat(~held_out, size)], minlength=len(words))
            rank = np.empty(len(words), np.uint32)  # common words get small numbers, which pack well
            rank[np.argsort(-times, kind="stable")] = np.arange(len(words), dtype=np.uint32)
            docs = C.pack(row=batch.column(0).to_numpy(), doc=batch.column(1).to_pylist(), held_out=held_out, size=size.astype(np.int32), ids=rank[ids], step=np.diff(words, prepend=np.uint64(0)), rank=rank)
            out = [(block, -1, docs)]
            for s, part in _by_segment(words, segments):
                out.append((block, s, C.pack(step=np.diff(words[part], prepend=np.uint64(0)), n=learned[part].astype(np.int32))))
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary()))], names=["block", "segment", "blob"])

    return run


def _grouped(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[list[tuple]]:
    """Rows of neighbours with one value in column ``key``."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns))):
            if rows and row[key] != now:
                yield rows
                rows = []
            now = row[key]
            rows.append(row)
    if rows:
        yield rows


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of one segment: exact counts over all blocks, sent back to each block."""
    for rows in _grouped(batches, 1):
        parts = [C.unpack(blob) for _, _, blob in rows]
        words = [np.cumsum(p["step"], dtype=np.uint64) for p in parts]
        each, total = _summed(np.concatenate(words), np.concatenate([p["n"] for p in parts]))
        known = [int((total > 0).sum()), int(total.sum())]
        for k, ((block, segment, _), w) in enumerate(zip(rows, words)):
            n = total[np.searchsorted(each, w)]
            blob = C.pack(n=n.astype(np.int64))
            distinct, all_ = known if k == 0 else (0, 0)
            yield pa.record_batch([pa.array([block], pa.int64()), pa.array([segment], pa.int32()), pa.array([blob], pa.binary()), pa.array([distinct], pa.int64()), pa.array([all_], pa.int64())], names=["block", "segment", "blob", "distinct", "total"])


def _block_pairs(docs: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of a block by rank, its distinct pairs, sorted, and the pair of each token."""
    word = np.empty(len(docs["rank"]), np.uint64)
    word[docs["rank"]] = np.cumsum(docs["step"], dtype=np.uint64)
    token_at = np.concatenate([[0], np.cumsum(docs["size"].astype(np.int64))])
    return word, *np.unique(pairs_of(word[docs["ids"]], token_at), return_inverse=True)


def _paired(segments: int):
    """(block, documents) to the pairs of each block and their training counts, by segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                docs = C.unpack(blob.as_py())
                _, each, at = _block_pairs(docs)
                n = np.bincount(at[np.repeat(~docs["held_out"], docs["size"])], minlength=len(each))
                out = [(block, s, C.pack(step=np.diff(each[part], prepend=np.uint64(0)), n=n[part].astype(np.int32))) for s, part in _by_segment(each, segments)]
                if out:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary()))], names=["block", "segment", "blob"])

    return run


def _levelled(segments: int):
    """Pairs of one segment: their levels by its filter, sent back to each block after its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, 1):
            parts = [C.unpack(blob) for _, _, blob in rows]
            pairs = [np.cumsum(p["step"], dtype=np.uint64) for p in parts]
            each, total = _summed(np.concatenate(pairs), np.concatenate([p["n"] for p in parts]))
            bits = filled(each, levels_of(total))
            level = probed(bits, 8 * len(bits), 1, each).astype(np.int8)
            for (block, segment, _), own in zip(rows, pairs):
                blob = C.pack(level=level[np.searchsorted(each, own)])
                yield pa.record_batch([pa.array([block], pa.int64()), pa.array([segments + segment], pa.int32()), pa.array([blob], pa.binary())], names=["block", "segment", "blob"])

    return run


def levels_of(total: np.ndarray) -> np.ndarray:
    """0 for pairs that were never seen, 1 for once, 2 for twice or more, 3 for four times or more ..."""
    return np.minimum(np.frexp(total.astype(float))[1], LEVELS - 1)


def _places(pairs: np.ndarray, level: int, bits: int) -> Iterator[np.ndarray]:
    """Bits, inside a segment, of (pair, level)."""
    seed = np.uint64((level + 1) * 0x9FB21C651E98DF25 % (1 << 64))
    place, step = C.mix(pairs ^ seed), C.mix(pairs + seed) | np.uint64(1)
    for _ in range(PROBES):
        yield (place % np.uint64(bits)).astype(np.int64)
        place = place + step


def filled(pairs: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The filter that holds each pair at all levels up to its own, as bytes."""
    bits = -(-max(LEAST_BITS, ENTRY_BITS * int(level.sum())) // 8) * 8
    held = np.zeros(bits, bool)
    for k in range(1, int(level.max(initial=0)) + 1):
        for place in _places(pairs[level >= k], k, bits):
            held[place] = True
    return np.packbits(held, bitorder="little")


def probed(bits: np.ndarray, segment_bits: int, least: int, pairs: np.ndarray) -> np.ndarray:
    """Level of each pair: 0 if it isn't known, else the last of the levels in a row that are."""
    out = np.zeros(len(pairs), np.int64)
    asked = np.arange(len(pairs))
    segments = len(bits) * 8 // segment_bits
    base = (pairs >> np.uint64(65 - segments.bit_length())).astype(np.int64) * segment_bits
    for level in range(least, LEVELS):
        if not len(asked):
            break
        there = np.ones(len(asked), bool)
        for place in _places(pairs[asked], level, segment_bits):
            place = place + base[asked]
            there &= (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0
        asked = asked[there]
        out[asked] = level
    return out


def shares(level: np.ndarray, before: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Share of a pair of this level among what follows its first word; the words' counts bound it."""
    level = np.minimum(level, levels_of(np.minimum(before, n)))
    return np.where(level > 0, 2.0 ** (level - 1) / np.maximum(1, before), 0.0)


def _scored(segments: int, total: int, distinct: int, doc_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, 0):
            docs = next(C.unpack(blob) for _, segment, blob in rows if segment < 0)
            word, _, pair = _block_pairs(docs)
            count = np.empty(len(word), np.int64)
            count[docs["rank"]] = np.concatenate([C.unpack(blob)["n"] for _, segment, blob in rows if 0 <= segment < segments])
            levels = np.concatenate([C.unpack(blob)["level"] for _, segment, blob in rows if segment >= segments])
            log_base = np.log10((count + 0.5) / (total + 0.5 * (distinct + 1)))
            ends = np.cumsum(docs["size"].astype(np.int64))
            starts = ends - docs["size"]
            found = [np.zeros(len(ends)) for _ in range(3)]
            for i, j in C.slices(np.concatenate([[0], ends]), 1 << 19):
                ids = docs["ids"][starts[i] : ends[j - 1]]
                at = np.append(starts[i:j], ends[j - 1]) - starts[i]
                n = count[ids]
                before = np.concatenate([[0], n[:-1]])
                before[at[:-1]] = count[word == END][0] if (word == END).any() else 0
                share = shares(levels[pair[starts[i] : ends[j - 1]]].astype(np.int64), before, n)
                base = log_base[ids]
                model = np.log10(MIX * share + (1 - MIX) * 10**base)
                for k, value in enumerate((n > 0, base, model)):
                    found[k][i:j] = np.add.reduceat(value.astype(float), at[:-1])
            m = len(ends)
            yield pa.record_batch(
                [pa.array(docs["row"]), pa.array(docs["doc"], doc_type), pa.array(docs["held_out"]), pa.array(docs["size"].astype(np.int64)), pa.array(found[0].astype(np.int64)),
                 pa.array(np.full(m, total, np.int64)), pa.array(found[1]), pa.array(found[2])],
                names=["_row", "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """_row, doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learns from rows that are not held out."""
    spark = docs.sparkSession
    n = C.partitions(spark)
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", held_out.alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    doc_type = {"string": pa.string(), "int": pa.int32()}.get(kind, pa.int64())
    segments = segment_count(n)

    path = scratch(spark, "blocks")
    written = rows.mapInArrow(_blocks(segments), "block long, segment int, blob binary").write
    written.option("compression", "none").parquet(path)  # the blobs are compressed
    blocks = spark.read.schema("block long, segment int, blob binary").parquet(path)
    dealt = blocks.where("segment >= 0").repartition(n, "segment").sortWithinPartitions("segment", "block")
    counted = C.cut_lineage(dealt.mapInArrow(_counted, "block long, segment int, blob binary, distinct long, total long"))
    known = counted.agg(F.sum("distinct").alias("distinct"), F.sum("total").alias("total")).first()
    pairs = blocks.where("segment < 0").select("block", "blob").mapInArrow(_paired(segments), "block long, segment int, blob binary")
    pairs = pairs.repartition(n, "segment").sortWithinPartitions("segment", "block")
    levelled = C.cut_lineage(pairs.mapInArrow(_levelled(segments), "block long, segment int, blob binary"))
    back = blocks.where("segment < 0").unionAll(counted.select("block", "segment", "blob")).unionAll(levelled).repartition(n, "block").sortWithinPartitions("block", "segment")
    schema = f"_row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return back.mapInArrow(_scored(segments, known.total or 0, known.distinct or 0, doc_type), schema)
