"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes.

A text is encoded by a byte-level vocabulary (A, with a space before it) and by a piece
vocabulary (B, which adds that space itself). Where a token of A and one of B end at the
same byte, both lists are cut, which gives groups of tokens that cover the same bytes. The
byte ends of each list become a dictionary from end to index; the intersection of the two
key sets, sorted, slices both lists. Inside a slice the links are the pairs of tokens that
end together: since no token is empty, these are its last token of A and its last of B.

Counts of id pairs are taken over the whole corpus. Documents travel nowhere for that: a
slice of documents (about ``LINKS`` links, or one long document) lists its different pairs
once, Spark sums them by pair and takes the highest of each B id, and sends the sums back
to the slices. What crosses the network grows with the slices, their packed lists of links
and their different pairs, and a pair that all documents hold comes once a slice.

Encoding is done once; slices are written to the shared folder. A task holds an Arrow
batch and one slice, however much it reads: a slice is written in rows of some hundred
kilobytes, files are cut into row groups of a few rows, since readers decode a row group
whole, a document without links counts too, so that a slice ends, and a slice meets its
sums in sorted rows, one slice at a time. The largest text a task can take is the one whose
token lists fit its memory (about 60 bytes a byte of text while it is encoded).

Defined cases: null and empty texts, and texts whose tokens don't spell the text with its
space (such as texts that hold U+2581), have no tokens, and their groups hash is empty.
Null and repeated ids are kept, since slices follow rows. Strings of special tokens are
ordinary text. Other columns are never read. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seamline.llm import common as C
from seamline.llm.tokens import byte_bpe, piece_bpe
from seamline.session import scratch
from seamline.streaming.runner import options

#: Links of a slice; text bytes that are encoded in one step. A longer text is taken alone.
LINKS, ENCODED = 500_000, 1 << 18
#: Links that a document counts as besides its own; links of a row of a slice, or one document; bytes of a row group, or one row.
DOCUMENT, PIECE, ROW_GROUP = 32, 100_000, 1 << 20
#: Texts that Spark decodes at once, and those that one Arrow batch takes to Python.
BATCHES = {"spark.sql.parquet.columnarReaderBatchSize": "256", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def sliced(a_ends: list[int], b_ends: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes in tokens of the groups that common byte ends cut."""
    a_at, b_at = dict(zip(a_ends, range(1, len(a_ends) + 1))), dict(zip(b_ends, range(1, len(b_ends) + 1)))
    common = sorted(a_at.keys() & b_at.keys())
    if len(common) < 2:  # the end of the text is always common
        return np.array([len(a_ends)], np.int32), np.array([len(b_ends)], np.int32)
    taken = itemgetter(*common)
    a_cuts, b_cuts = (np.frombuffer(array("i", taken(at)), np.int32) for at in (a_at, b_at))
    return np.diff(a_cuts, prepend=np.int32(0)), np.diff(b_cuts, prepend=np.int32(0))


class Aligner:
    """Encodes a text both ways and cuts the two lists."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = byte_bpe(a_path), piece_bpe(b_path)
        if not all(self.a.bytes) or not all(self.b.bytes):
            raise ValueError("a vocabulary has an empty token")
        self.a_length, self.b_length = (np.array(list(map(len, t.bytes))) for t in (self.a, self.b))

    def align(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and B and the groups' sizes in both, all empty for a text without tokens."""
        if text:
            a, b, whole = self.a.encode(" " + text), self.b.encode(text), b" " + text.encode()
            a_ids, b_ids = (np.frombuffer(array("i", ids), np.int32) for ids in (a, b))
            a_ends, b_ends = np.cumsum(self.a_length[a_ids]), np.cumsum(self.b_length[b_ids])
            # A byte-level vocabulary always spells the text; pieces may not.
            if a_ends[-1] == b_ends[-1] == len(whole) and (self.b.spells(text) or b"".join(map(self.b.bytes.__getitem__, b)) == whole):
                return a_ids, b_ids, *sliced(a_ends.tolist(), b_ends.tolist())
        return (np.zeros(0, np.int32),) * 4


    def steps(self, texts: pa.Array) -> Iterator[tuple[int, int, list[tuple]]]:
        """Ranges of a text column of about ``ENCODED`` bytes each, with what ``align`` gives for their texts."""
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        for i, j in C.slices(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), ENCODED):
            yield i, j, [self.align(t) for t in texts.slice(i, j - i).to_pylist()]


def _lists(lists: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), pa.array(np.concatenate(lists)))


LISTS = ["a_ids", "b_ids", "a_sizes", "b_sizes"]


def _aligned(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(a_path, b_path)
        for batch in batches:
            for i, j, done in aligner.steps(batch.column(1)):
                yield pa.record_batch([batch.column(0).slice(i, j - i), *map(_lists, zip(*done))], names=["_id", *LISTS])

    return run


def align(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id") -> DataFrame:
    """The id, a_ids, b_ids and the groups' sizes in tokens (a_sizes, b_sizes) of each row of ``docs``."""
    kind = docs.schema[key].dataType.simpleString()
    fields = ", ".join(f"{c} array<int>" for c in LISTS)
    return docs.select(F.col(key).alias("_id"), "text").mapInArrow(_aligned(a_path, b_path), f"_id {kind}, {fields}").withColumnRenamed("_id", key)


def decimals(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each id below ``most`` followed by ``,``, ``|``, ``;`` and nothing, and how many they are."""
    names = [b"%d%s" % (k, end) for k in range(most) for end in (b",", b"|", b";", b"")]
    return np.array(names).view(np.uint8).reshape(len(names), -1), np.array(list(map(len, names)))


def spelled(a: np.ndarray, b: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray, group_at: np.ndarray, names: tuple[np.ndarray, np.ndarray]) -> list[str]:
    """Hash of ``a1,a2|b1;a3|b2,b3`` of each row; ``names`` as ``decimals`` gives them."""
    a_end, b_end = np.cumsum(a_sizes), np.cumsum(b_sizes)
    a_mark, b_mark = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    a_mark[a_end - 1], b_mark[b_end - 1] = 1, 2
    rows = np.flatnonzero(np.diff(group_at))
    b_mark[b_end[group_at[rows + 1] - 1] - 1] = 3
    order = np.empty(len(a) + len(b), np.int64)
    order[np.arange(len(a)) + np.repeat(b_end - b_sizes, a_sizes)] = a.astype(np.int64) * 4 + a_mark
    order[np.arange(len(b)) + np.repeat(a_end, b_sizes)] = b.astype(np.int64) * 4 + b_mark
    letters, length = names[0], names[1][order]
    text = letters[order][np.arange(letters.shape[1]) < length[:, None]]
    cut = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], a_end + b_end])[group_at]]
    return [hashlib.sha256(text[x:y]).hexdigest() if y > x else "" for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())]


PAIR = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])
NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]


def _kind(pairs: int) -> str:
    """Type of the numbers of so many pairs; differences of sorted numbers wrap round in it."""
    return "<u2" if pairs <= 1 << 16 else "<u4"


def _part(number: int, ids: list[pa.Array], done: list[tuple], names: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    """One slice in rows of about ``PIECE`` links: documents' numbers and links, and its different pairs with the first row."""
    (a, b, a_sizes, b_sizes), (n_a, n_b, n_groups, _) = ([f(x) for x in zip(*done)] for f in (np.concatenate, lambda x: np.array(list(map(len, x)), np.int64)))
    last_a, last_b = a[np.cumsum(a_sizes) - 1].astype(np.int64), b[np.cumsum(b_sizes) - 1].astype(np.int64)
    pairs, which, n = np.unique(last_a << 32 | last_b, return_inverse=True, return_counts=True)
    pair = pa.StructArray.from_arrays([pa.array((pairs >> 32).astype(np.int32)), pa.array((pairs & 0xFFFFFFFF).astype(np.int32)), pa.array(n.astype(np.int64))], fields=list(PAIR))
    at = np.concatenate([[0], np.cumsum(n_groups)])
    hashes = pa.array(spelled(a, b, a_sizes, b_sizes, at, names), pa.string())
    docs = pa.StructArray.from_arrays([pa.concat_arrays(ids), *map(pa.array, (n_a, n_b, n_groups, n_groups)), hashes], names=["id", *NUMBERS, "groups"])
    first = np.repeat(np.arange(len(n_groups)) * len(pairs), n_groups)
    which = np.sort(first + which) - first  # the links of a document in the order of their pairs
    cuts = [0, *(j for _, j in C.slices(at, PIECE))]
    packed = [zstandard.ZstdCompressor(level=1).compress(np.diff(which[i:j], prepend=0).astype(_kind(len(pairs))).tobytes()) for i, j in zip(at[cuts[:-1]], at[cuts[1:]])]
    rows = [pa.ListArray.from_arrays(pa.array(x, pa.int32()), y) for x, y in ((cuts, docs), ([0] + [len(pair)] * len(packed), pair))]
    return pa.record_batch([pa.array([number] * len(packed), pa.int64()), *rows, pa.array(packed, pa.binary())], names=["slice", "docs", "pairs", "which"])


def _parts(a_path: str, b_path: str, links: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = Aligner(a_path, b_path), TaskContext.get().partitionId() << 33
        names = decimals(max(len(aligner.a.bytes), len(aligner.b.bytes)))
        ids, done, held = [], [], 0
        for batch in batches:
            for i, j, part in aligner.steps(batch.column(1)):
                ids.append(batch.column(0).slice(i, j - i))
                done += part
                held += sum(len(x[2]) + DOCUMENT for x in part)
                if held >= links:
                    yield _part(number, ids, done, names)
                    ids, done, held, number = [], [], 0, number + 1
        if done:
            yield _part(number, ids, done, names)

    return run


def slices(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", links: int = LINKS) -> DataFrame:
    """Slices of documents: their numbers, their different pairs with counts, and which pair each link is (packed).

    The numbering belongs to the run, so the result is written once and read again. Row
    groups and pages are measured after each row; by default, after a hundred.
    """
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    schema = f"slice long, docs array<struct<id: {kind}, {', '.join(f'{c}: long' for c in NUMBERS)}, `groups`: string>>, pairs array<struct<a: int, b: int, n: long>>, which binary"
    path = scratch(spark, "slices")
    layout = {"compression": "zstd", "parquet.block.size": ROW_GROUP, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1, "parquet.enable.dictionary#which": "false"}
    with options(spark, BATCHES):
        docs.select(F.col(key).alias("_id"), "text").mapInArrow(_parts(a_path, b_path, links), schema).write.options(**layout).parquet(path)
    return spark.read.schema(schema).parquet(path)


def pair_counts(parts: DataFrame) -> DataFrame:
    """(a, b, n, best): links of each id pair, and whether no other pair of the B id has more."""
    counts = parts.select(F.explode("pairs").alias("p")).select("p.*").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))


def _summed(part: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of one slice, whose pairs are counted in ``counts``."""
    docs, place, unpack = part["docs"].combine_chunks().flatten(), counts["place"].to_numpy(), zstandard.ZstdDecompressor().decompress
    kind = _kind(len(place))
    which = np.concatenate([np.cumsum(np.frombuffer(unpack(x), kind), dtype=kind) for x in part["which"].to_pylist()])
    at = np.concatenate([[0], np.cumsum(docs.field("n_links").to_numpy())])
    sums = []
    for name in ("best", "n"):
        values = np.zeros(len(place), np.int64)
        values[place] = counts[name].to_numpy()
        upto = np.concatenate([[0], np.cumsum(values[which])])
        sums.append(pa.array(upto[at[1:]] - upto[at[:-1]]))
    return pa.table([docs.field("id"), *(docs.field(c) for c in NUMBERS), *sums, docs.field("groups")], names=["_id", *NUMBERS, "n_best", "count_sum", "groups_sha256"])


def digest(docs: DataFrame, a_path: str, b_path: str, links: int = LINKS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = slices(docs, a_path, b_path, links=links)
    rows = parts.select("slice", F.posexplode("pairs").alias("place", "p")).select("slice", "place", "p.a", "p.b")
    known = rows.join(pair_counts(parts), ["a", "b"]).select(F.col("slice").alias("of"), "place", "n", "best")
    long = ", ".join(f"{c} long" for c in (*NUMBERS, "n_best", "count_sum"))
    both = parts.select("slice", "docs", "which").groupBy("slice").cogroup(known.groupBy("of"))
    return both.applyInArrow(_summed, f"_id {kind}, {long}, groups_sha256 string").withColumnRenamed("_id", "doc_id")
