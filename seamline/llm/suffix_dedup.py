"""Suffix-array dedup of bytes: a sparse suffix array over content-chosen places.

Every ``length``-byte string holds an anchor: the place of its smallest
``GRAM``-byte hash, which equal strings choose alike. Only suffixes that start at
anchors are sorted, about one byte in ``length / 2``. A suffix travels with the
bytes of all strings that chose it.

* Splitters come from a bounded sample of anchors; suffixes go to the range of
  their leading eight bytes.
* A bucket sorts its suffixes by multikey quicksort with eight bytes as a symbol,
  and the bytes before the anchors in the same way, read backwards. Neighbours'
  common prefixes give classes: for each distance d, strings that begin d bytes
  before their anchor are equal when the d bytes before it and the ``length - d``
  bytes after it are in equal classes. Nothing is decided by a hash there.
* Equal leading bytes are never parted by a splitter, so neighbours that could be
  equal never lie on two sides of a boundary; what a bucket compares across its
  inner ranges of symbols is settled by the sort.

Before the shuffle each Arrow batch settles copies it has seen twice and sends
one of them, marked as repeated, so a group of copies that holds a third of all
rows sends one string a batch.

A first pass counts the strings of each part of the grams. Parts far above the mean,
such as that of a header which a third of all texts hold, each time before other
bytes, are dealt out further: their strings of ``length`` bytes travel one by one, as
two 64-bit hashes, to the bucket of the string itself, and are sorted and counted
there. So no task holds all suffixes of a hot gram, and every string still meets all
its copies. Only there do hashes, of 128 bits together, decide.

Null texts are empty and lose nothing. Rows are told apart by place: null and
repeated ids are kept, a repeated row counts as another place. Further columns
are never read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm import common as C
from seamline.llm.substring_dedup import (
    BUCKETS_PER_PARTITION, HOT_SHARE, HOT_STRINGS, PARTS, _by_key, by_bucket, hottest, joined_spans, same_windows, settled_windows, window_places,
)

LENGTH, GRAM = 400, 24
#: Rows and anchors a row that the splitters are taken from.
SAMPLED_ROWS, SAMPLED_ANCHORS = 2_000, 64


def _symbols(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one number that sorts like the bytes."""
    if len(data) < 8:
        return np.zeros(0, np.uint64)
    view = np.lib.stride_tricks.as_strided(np.ascontiguousarray(data), (len(data) - 7, 8), (1, 1))
    return np.ascontiguousarray(view).view(">u8").ravel().astype(np.uint64)


def _anchored(data: np.ndarray, at: np.ndarray, length: int):
    """Of one slice: row, first byte, bytes, strings, bytes before the anchor, leading symbol, hash of the gram, hash of the bytes."""
    if len(data) < length:
        return None
    symbol = _symbols(data)
    n = len(data) - GRAM + 1
    gram = C.mix(symbol[:n] * C.ODD + np.uint64(1))
    for step in range(8, GRAM, 8):
        gram = C.mix(gram ^ (symbol[step : step + n] * C.ODD))
    row, begin, strings, anchor = C.runs_of_anchors(gram, at, length, GRAM)
    if not len(row):
        return None
    size = strings + length - 1
    prefix = C.running(C._BYTE[data])
    return row, begin, size, strings, anchor - begin, symbol[anchor], gram[anchor], C.between(prefix, begin, begin + size)


def _sampled(length: int):
    def run(batches):
        for batch in batches:
            data, at = C.text_buffer(batch.column(0))
            for i, j in C.slices(at):
                part = _anchored(data[at[i] : at[j]], at[i : j + 1] - at[i], length)
                if part is not None:
                    row, lead, gram = part[0], part[5], part[6]
                    order = np.lexsort((gram, row))
                    rank = np.arange(len(order)) - np.searchsorted(row[order], row[order])
                    yield pa.record_batch([pa.array(lead[order[rank < SAMPLED_ANCHORS]].view(np.int64))], names=["lead"])

    return run


def splitters(rows: DataFrame, length: int, buckets: int) -> np.ndarray:
    """Leading symbols that part a bounded sample of anchors evenly."""
    share = min(1.0, 2 * SAMPLED_ROWS / max(1, rows.count()))
    sample = rows.select("text").sample(share, seed=7).limit(SAMPLED_ROWS).mapInArrow(_sampled(length), "lead long")
    lead = np.sort(np.array([r.lead for r in sample.collect()], np.int64).view(np.uint64))
    return np.unique(lead[np.linspace(0, len(lead) - 1, buckets + 1).astype(int)[1:-1]]) if len(lead) else lead


def _strings(batch: pa.RecordBatch, length: int):
    """Bytes of an Arrow batch of (_row, text) and the strings around its anchors; None without any."""
    ids = batch.column(0).to_numpy()
    data, at = C.text_buffer(batch.column(1))
    found = []
    for i, j in C.slices(at):
        part = _anchored(data[at[i] : at[j]], at[i : j + 1] - at[i], length)
        if part is not None:
            row, begin, *rest = part
            found.append((ids[row + i], begin + at[i], begin + at[i] - at[row + i], *rest))
    if not found:
        return None
    row, place, begin, size, strings, before, lead, gram, whole = map(np.concatenate, zip(*found))
    return data, row, place, begin, size, strings, before, lead, gram, whole ^ C.mix(gram)


def _counted(parts: int, length: int):
    """Arrow batches of (_row, text) to rows (part, n): different strings of a batch in each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _strings(batch, length)
            if found is not None:
                _, first = np.unique(found[9], return_index=True)
                part, n = np.unique((found[8][first] % np.uint64(parts)).astype(np.int64), return_counts=True)
                yield pa.record_batch([pa.array(part), pa.array(n.astype(np.int64))], names=["part", "n"])

    return run


def hot_parts(rows: DataFrame, parts: int, length: int, least: int = HOT_STRINGS, share: int = HOT_SHARE) -> np.ndarray:
    """Parts of grams that too many strings of the batches share."""
    return hottest(rows.select("_row", "text").mapInArrow(_counted(parts, length), "part long, n long"), parts, least, share)


def _split(bucket: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(bucket, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []


def _one_by_one(data, row, place, begin, strings, twice, length: int, buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, blob) of single strings by their two hashes, and the places that repeat already, a slice at a time."""
    for i, j in C.slices(np.concatenate([[0], np.cumsum(strings + length)])):
        size = strings[i:j] + length - 1
        text = data[C.ranges(place[i:j], size)]
        start = C.ranges(np.cumsum(size) - size, strings[i:j])
        one = C.between(C.running(C._BYTE[text]), start, start + length)
        two = C.between(C.running(C.mix(C._BYTE ^ C.ODD)[text], C.OTHER_BASE), start, start + length, C.OTHER_INVERSE)
        owner = np.repeat(np.arange(i, j), strings[i:j])
        own, at, again = row[owner], begin[owner] + C.ranges(np.zeros(j - i, np.int64), strings[i:j]), twice[owner]
        which, many = same_windows(one, two, again)
        hit = many[which]
        done, a, b = window_places(own[hit], at[hit], length)
        _, keep = np.unique(which, return_index=True)
        bucket = (one[keep] % np.uint64(buckets)).astype(np.int64)
        yield int(bucket[0]), C.pack(row=done, start=a, end=b)
        for group in _split(bucket):
            k = keep[group]
            yield int(bucket[group[0]]), C.pack(one=one[k], two=two[k], row=own[k], begin=at[k], twice=hit[k])


def _packed(cuts: np.ndarray, buckets: int, hot: np.ndarray, length: int):
    """Arrow batches of (_row, text) to rows (bucket, blob)."""
    parts = np.uint64(buckets * PARTS)

    def rows_of(out: list[tuple[int, bytes]]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([k for k, _ in out], pa.int32()), pa.array([v for _, v in out], pa.binary())], names=["bucket", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _strings(batch, length)
            if found is None:
                continue
            data, row, place, begin, size, strings, before, lead, gram, whole = found
            first, same, count = C.exact_groups(whole, lambda i: data[place[i] : place[i] + size[i]].tobytes())
            again = count[same] > 1
            out = [(int(row[0] % (len(cuts) + 1)), C.pack(row=row[again], start=begin[again], end=(begin + size)[again]))]
            alone = np.isin((gram[first] % parts).astype(np.int64), hot)
            few, count = first[~alone], count[~alone]
            bucket = np.searchsorted(cuts, lead[few], "right")
            for group in _split(bucket):
                pick = few[group]
                text = data[C.ranges(place[pick], size[pick])].tobytes()
                out.append(
                    (int(bucket[group[0]]), C.pack(text=text, gram=gram[pick], row=row[pick], begin=begin[pick], size=size[pick].astype(np.int32), before=before[pick].astype(np.int32), twice=count[group] > 1))
                )
            yield rows_of(out)
            pick = first[alone]
            for one in _one_by_one(data, row[pick], place[pick], begin[pick], strings[pick], again[pick], length, buckets):
                yield rows_of([one])

    return run


def multikey_sort(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of bytes, and the bytes each has in common with the one before.

    Multikey quicksort with eight bytes as a symbol: rows are split by a symbol,
    and only rows that still tie go on to the next.
    """
    rows, width = matrix.shape
    wide = -(-width // 8) * 8
    padded = np.zeros((rows, wide), np.uint8)
    padded[:, :width] = matrix
    symbols = padded.view(">u8").astype(np.uint64)
    order, common = np.arange(rows), np.full(rows, width, np.int64)
    if rows:
        common[0] = 0
    tied = np.zeros(rows, np.int64)  # the group that a sorted place is in
    active = np.arange(rows)
    for k in range(wide // 8):
        if not len(active):
            break
        value = symbols[order[active], k]
        inner = np.lexsort((value, tied[active]))
        order[active] = order[active][inner]
        value, group = value[inner], tied[active]
        fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (value[1:] != value[:-1])])
        parted = np.flatnonzero(fresh[1:] & (group[1:] == group[:-1])) + 1
        differ = value[parted] ^ value[parted - 1]
        same = np.zeros(len(parted), np.int64)
        for b in range(1, 8):
            same += differ < (np.uint64(1) << np.uint64(64 - 8 * b))
        common[active[parted]] = np.minimum(width, 8 * k + same)
        tied[active] = active[np.maximum.accumulate(np.where(fresh, np.arange(len(active)), 0))]
        sizes = np.bincount(np.cumsum(fresh) - 1)
        active = active[np.repeat(sizes > 1, sizes)]
    return order, common


def _matrix(text: np.ndarray, start: np.ndarray, size: np.ndarray, width: int, step: int) -> np.ndarray:
    """Up to ``width`` bytes from each start, forwards or backwards; the rest is zero."""
    out = np.zeros((len(start), width), np.uint8)
    for i in range(0, len(start), 2048):
        span = np.arange(width)
        there = span < size[i : i + 2048, None]
        place = start[i : i + 2048, None] + step * span
        out[i : i + 2048] = np.where(there, text[np.where(there, place, 0)], 0)
    return out


def _repeated(text: np.ndarray, at: np.ndarray, size: np.ndarray, before: np.ndarray, twice: np.ndarray, length: int) -> np.ndarray:
    """[suffix, d]: the string that begins d bytes before the anchor occurs twice."""
    m = len(at)
    anchor, width = at + before, length - GRAM + 1
    strings = size - length + 1
    right_order, right_common = multikey_sort(_matrix(text, anchor, size - before, length, 1))
    left_order, left_common = multikey_sort(_matrix(text, anchor - 1, before, width, -1))
    weight = 1 + twice
    out = np.zeros((m, width), bool)
    right, left = np.zeros(m, np.int64), np.zeros(m, np.int64)
    for d in range(width):
        there = np.flatnonzero((d <= before) & (d > before - strings))
        if len(there) < 2 and not twice[there].any():
            continue
        right[right_order] = np.cumsum(right_common < length - d)
        left[left_order] = np.cumsum(left_common < d)
        key = right[there] * (m + 1) + left[there]
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        total = np.add.reduceat(weight[there][order], np.flatnonzero(fresh))
        out[there[order], d] = total[np.cumsum(fresh) - 1] > 1
    return out


def _settle(parts: list[dict], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places (row, first byte, byte after the last) of one bucket that repeat."""
    for p in parts:
        if "start" in p and len(p["row"]):
            yield p["row"], p["start"], p["end"]
    yield from settled_windows(parts, length)
    parts = [p for p in parts if "text" in p]
    if not parts:
        return
    gram, row, begin, size, before, twice = (np.concatenate([p[k] for p in parts]) for k in ("gram", "row", "begin", "size", "before", "twice"))
    text = np.frombuffer(b"".join(p["text"] for p in parts), np.uint8)
    size, before = size.astype(np.int64), before.astype(np.int64)
    at = np.cumsum(size) - size
    _, same, count = np.unique(gram, return_inverse=True, return_counts=True)
    keep = np.flatnonzero(count[same] > 1)  # the rest has no string in common with anything
    keep = keep[np.argsort(same[keep], kind="stable")]
    for group in _by_key(keep, same[keep], 8_000):
        seen: dict[bytes, int] = {}
        which = np.array([seen.setdefault(text[at[i] : at[i] + size[i]].tobytes(), len(seen)) for i in group])
        total = np.bincount(which, weights=1 + twice[group])
        equal = total[which] >= 2
        hit = group[equal & ~twice[group]]
        if len(hit):
            yield row[hit], begin[hit], begin[hit] + size[hit]
        kinds, first = np.unique(which, return_index=True)
        _, of_gram, kinds_of_gram = np.unique(same[group[first]], return_inverse=True, return_counts=True)
        mixed = kinds_of_gram[of_gram] > 1  # a gram before which or after which several texts stand
        if not mixed.any():
            continue
        pick, many = group[first[mixed]], total[kinds[mixed]] >= 2
        flags = _repeated(text, at[pick], size[pick], before[pick], many.astype(np.int64), length)
        for i, mark in zip(pick[~many], flags[~many]):
            d = np.flatnonzero(mark)
            if len(d):
                a = begin[i] + before[i] - d
                a, b = C.union(a, a + length)
                yield np.full(len(a), row[i]), a, b


def repeated_spans(rows: DataFrame, length: int = LENGTH, least: int = HOT_STRINGS, share: int = HOT_SHARE) -> DataFrame:
    """(_row, start, end) in bytes, of rows (_row, text). ``least`` and ``share`` say which parts are hot."""
    if length < 2 * GRAM:
        raise ValueError(f"strings must have at least {2 * GRAM} bytes")
    n = C.partitions(rows.sparkSession)
    buckets = n * BUCKETS_PER_PARTITION
    cuts = splitters(rows, length, buckets)
    hot = hot_parts(rows, buckets * PARTS, length, least, share)
    packed = rows.select("_row", "text").mapInArrow(_packed(cuts, buckets, hot, length), "bucket int, blob binary")
    dealt = packed.repartition(n, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(by_bucket(lambda parts: _settle(parts, length)), "_row long, start long, end long")


def left_bytes(text: str | None, spans) -> tuple[int, int, int, bytes]:
    """Bytes, removed bytes, maximal removed runs, and what is left."""
    raw = (text or "").encode()
    if not spans:
        return len(raw), 0, 0, raw
    start, end = C.union(np.array([s["start"] for s in spans]), np.array([s["end"] for s in spans]))
    cuts = [0, *np.column_stack([start, end]).ravel().tolist(), len(raw)]
    left = b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2]))
    return len(raw), len(raw) - len(left), len(start), left


def digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of ``docs``."""
    rows = C.with_row(docs, "doc_id", "text")

    def run(batches):
        for batch in batches:
            out = [left_bytes(t, s) for t, s in zip(batch.column("text").to_pylist(), batch.column("_spans").to_pylist())]
            counts = [pa.array([o[k] for o in out], pa.int64()) for k in range(3)]
            sha = pa.array([hashlib.sha256(o[3]).hexdigest() for o in out], pa.string())
            yield pa.record_batch([batch.column("doc_id"), *counts, sha], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = joined_spans(rows, repeated_spans(rows, length))
    kind = joined.schema["doc_id"].dataType.simpleString()
    return joined.select("doc_id", "text", "_spans").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, kept (binary: the bytes left), spans (start, end) for each row of ``docs``."""
    rows = C.with_row(docs, "doc_id", "text")

    def run(batches):
        for batch in batches:
            out = [left_bytes(t, s)[3] for t, s in zip(batch.column("text").to_pylist(), batch.column("_spans").to_pylist())]
            yield pa.record_batch([batch.column("doc_id"), pa.array(out, pa.binary()), batch.column("_spans")], names=["doc_id", "kept", "spans"])

    joined = joined_spans(rows, repeated_spans(rows, length)).select("doc_id", "text", "_spans")
    kinds = {f.name: f.dataType.simpleString() for f in joined.schema}
    return joined.mapInArrow(run, f"doc_id {kinds['doc_id']}, kept binary, spans {kinds['_spans']}")
