"""Helpers shared by the operators: rows, Arrow batches, hashes, packed blobs, components."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.session import cut_lineage

#: Text bytes that one round of vector work takes; a longer text is taken alone.
SLICE_BYTES = 2 << 20
#: The white space that ends a word.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
ODD = np.uint64(0x9E3779B97F4A7C15)
BASE = 0xD6E8FEB86659FD93


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_row(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of ``docs`` and ``_row``, which tells rows apart even where ids are null or repeat.

    The number comes from the scan's partition and place, so a scan that is run
    again after a loss gives the same one.
    """
    return docs.select(F.monotonically_increasing_id().alias("_row"), *columns)


def quoted(name: str) -> Column:
    """A column by its very name, whatever signs are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_struct(columns: list[str]) -> Column:
    return F.struct(*map(quoted, columns))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: Column | str, n: int) -> Column:
    """crc32 of the value as text, modulo ``n``; null stays null."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(c.cast("string").cast("binary")) % F.lit(n)


def text_buffer(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row starts; null is empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_binary()) if not pa.types.is_large_binary(array.type) else array
    array = array.fill_null(b"")
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[at[0] : at[-1]], at - at[0]


def slices(at: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes, or of one row."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads 64-bit values (multiply and xor-shift)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * ODD)
_tables: dict[int, np.ndarray] = {}


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base ** 0, 1, 2 ... modulo 2 ** 64."""
    have = _tables.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n).bit_length())
        with np.errstate(over="ignore"):
            have = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, base, np.uint64)]), dtype=np.uint64)
        if n <= 1 << 22:
            _tables[base] = have
    return have[:n]


INVERSE = pow(BASE, -1, 1 << 64)
#: A second base, for hashes that shall fail apart from the first.
OTHER_BASE = 0xA0761D6478BD642F
OTHER_INVERSE = pow(OTHER_BASE, -1, 1 << 64)


def running(values: np.ndarray, base: int = BASE) -> np.ndarray:
    """Prefix sums of a polynomial hash; ``between`` takes a run's hash from them.

    Runs of up to some hundred symbols are told apart well; over very long runs of two
    symbols in special patterns a polynomial modulo 2 ** 64 is weak, so symbols that are
    words come from ``word_hashes`` and decisions compare what was hashed.
    """
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values), base), out=out[1:])
    return out


def between(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, inverse: int = INVERSE) -> np.ndarray:
    back = powers(int(start.max()) + 1 if len(start) else 1, inverse)
    return mix((prefix[end] - prefix[start]) * back[start] + (end - start).astype(np.uint64) * ODD)


def exact_groups(hashes: np.ndarray, text_of: Callable[[int], bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place of each different text, the text's number at each place, and how often it occurs.

    Texts are grouped by hash; those of one hash are then compared, and told apart where they differ.
    """
    _, first, same, count = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count[same] > 1)
    shared = shared[np.argsort(same[shared], kind="stable")]
    group, text, apart = -1, b"", []
    for i, g in zip(shared.tolist(), same[shared].tolist()):
        if g != group:
            group, text = g, text_of(i)
        elif text_of(i) != text:
            apart.append(i)
    if apart:
        numbers: dict[tuple[int, bytes], int] = {}
        for i in apart:
            same[i] = numbers.setdefault((int(same[i]), text_of(i)), len(first) + len(numbers))
        _, first, same, count = np.unique(same, return_index=True, return_inverse=True, return_counts=True)
    return first, same, count


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of words before each row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    solid = ~SPACES[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | edge[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, at)


#: Words above this many bytes are hashed one by one.
BLOCK_HASHED = 64


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each word's bytes; hashes of two seeds fail apart from each other.

    Eight bytes a step go through a keyed mixer, for all words at once, so words of up
    to eight bytes and one length never meet. Longer words than ``BLOCK_HASHED`` take
    a cryptographic digest, for which nobody can build words that meet.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = (ends - starts).astype(np.int64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place
    out = mix(lengths.astype(np.uint64) * ODD + np.uint64(seed * 0xD1B54A32D192ED03 % (1 << 64)))
    long = lengths > BLOCK_HASHED
    place = np.flatnonzero(~long)
    for step in range(0, BLOCK_HASHED, 8):
        place = place[lengths[place] > step]
        if not len(place):
            break
        left = np.minimum(lengths[place] - step, 8).astype(np.uint64)
        block = eight[starts[place] + step] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left))
        out[place] = mix(out[place] * ODD ^ mix(block + np.uint64(step + 1)))
    for i in np.flatnonzero(long).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=b"%d" % seed).digest()
        out[i] = np.uint64(int.from_bytes(digest, "little"))
    return out


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def runs_of_anchors(hashes: np.ndarray, row_at: np.ndarray, window: int, gram: int):
    """Runs of windows that share the place of their smallest hash.

    ``hashes`` has the hash of the ``gram`` symbols from each place. ``row_at``
    has the first symbol of each row. Gives row, first window, number of
    windows and anchor of each run. The leftmost of equal hashes counts, so
    equal windows have the same anchor wherever they are.
    """
    none = (np.zeros(0, np.int64),) * 4
    width = window - gram + 1
    if len(hashes) < width:
        return none
    bits = max(1, int(len(hashes)).bit_length())
    keyed = (hashes >> np.uint64(bits) << np.uint64(bits)) | np.arange(len(hashes), dtype=np.uint64)
    anchor = (window_minimum(keyed, width) & np.uint64((1 << bits) - 1)).astype(np.int64)
    lengths = np.diff(row_at)
    whole = np.flatnonzero(lengths >= window)
    if not len(whole):
        return none
    counts = lengths[whole] - window + 1
    ends = np.cumsum(counts)
    place = np.arange(ends[-1]) + np.repeat(row_at[whole] - (ends - counts), counts)
    anchor = anchor[place]
    cut = np.ones(len(anchor), bool)
    cut[1:] = anchor[1:] != anchor[:-1]
    cut[(ends - counts)] = True
    first = np.flatnonzero(cut)
    sizes = np.diff(np.concatenate([first, [len(anchor)]]))
    rows = whole[np.searchsorted(ends, first, "right")]
    return rows, place[first], sizes, anchor[first]


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the ranges, one after the other."""
    total = int(size.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(size)
    return np.arange(total, dtype=np.int64) + np.repeat(start - (ends - size), size)


def pack(**parts) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(parts, protocol=5))


def unpack(blob: bytes) -> dict:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def sent(spark: SparkSession, thing):
    """Broadcast of an object's attributes: workers that can't import its class get it from ``received``."""
    return spark.sparkContext.broadcast(vars(thing))


def received(kind: type, held):
    thing = kind.__new__(kind)
    vars(thing).update(held.value)
    return thing


def union(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the covered places."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, far = start[order], np.maximum.accumulate(end[order])
    cut = np.flatnonzero(np.concatenate([[True], start[1:] > far[:-1]]))
    return start[cut], far[np.concatenate([cut[1:] - 1, [len(far) - 1]])]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for the nodes of ``edges`` (a, b).

    Large-star and small-star steps in turn. Each takes the smallest neighbour
    of a node by an aggregate that combines before the shuffle and joins it back;
    a hot node's join partitions are split by adaptive execution. Lineage is cut
    in the shared folder at each round, so a lost executor costs one round.
    """
    now = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state_of = (F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    before = now.agg(*state_of).first()
    for _ in range(rounds if before[0] else 0):
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        now = cut_lineage(
            large.join(small, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.*").where("a <> b").distinct()
        )
        state = now.agg(*state_of).first()
        if state == before:
            break
        before = state
    else:
        if before[0]:
            raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
