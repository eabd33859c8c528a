"""Substring dedup by super-k-mers: repeated runs of words are removed from documents.

A window is ``window`` consecutive words of one document. Neighbouring windows
whose smallest ``gram``-word hash lies at the same place travel as one packed
string (a super-k-mer) to the bucket of that hash, so equal windows meet. A
bucket sorts the windows of its strings and counts them exactly.

Before the shuffle each Arrow batch combines equal super-k-mers: their windows
repeat for sure, so their places are settled at once and one copy travels, marked
as repeated. A passage that a third of all documents hold thus sends one string a
batch, not one a document.

A first pass counts the strings of each part of a bucket. Parts far above the mean,
such as that of a phrase that a third of all texts use, each time in other words, are
dealt out further: their windows travel one by one, as two 64-bit hashes, to the
bucket of the window itself, and are sorted and counted there. So no task holds all
strings of a hot minimiser, and every window still meets all its copies. The two hashes
of a window are over word hashes of their own; everywhere else words are compared.

Nulls and texts without words have no windows. Rows are told apart by their
place, so null and repeated ids are kept, and a repeated row is another place of
the same words. Further input columns are carried and never read. An empty table
gives an empty result. A text below ``window`` words only loses nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamline.llm import common as C

WINDOW, GRAM, BUCKETS_PER_PARTITION = 35, 6, 4
#: Parts of a bucket; a part is hot above ``HOT_STRINGS`` strings and ``HOT_SHARE`` times the mean.
PARTS, HOT_STRINGS, HOT_SHARE = 16, 50_000, 16


def _super_kmers(data: np.ndarray, at: np.ndarray, window: int, gram: int):
    """Of one slice: row, first word, words, windows, hash of the minimiser, hash of the words; and the words' places."""
    starts, ends, row_at = C.words(data, at)
    hashes = C.word_hashes(data, starts, ends)
    if len(hashes) < window:
        return None
    prefix = C.running(hashes)
    first = np.arange(len(hashes) - gram + 1)
    grams = C.between(prefix, first, first + gram)
    row, begin, windows, anchor = C.runs_of_anchors(grams, row_at, window, gram)
    if not len(row):
        return None
    size = windows + window - 1
    return row, begin - row_at[row], size, windows, grams[anchor], C.between(prefix, begin, begin + size), starts[begin], ends[begin + size - 1]


def _strings(batch: pa.RecordBatch, window: int, gram: int):
    """Bytes of an Arrow batch of (_row, text) and its super-k-mers, with places in those bytes; None without any."""
    ids = batch.column(0).to_numpy()
    data, at = C.text_buffer(batch.column(1))
    found = []
    for i, j in C.slices(at):
        part = _super_kmers(data[at[i] : at[j]], at[i : j + 1] - at[i], window, gram)
        if part is not None:
            row, begin, size, windows, key, whole, start, end = part
            found.append((ids[row + i], begin, size, windows, key, whole, start + at[i], end + at[i]))
    return (data, *map(np.concatenate, zip(*found))) if found else None


def _counted(parts: int, window: int, gram: int):
    """Arrow batches of (_row, text) to rows (part, n): different strings of a batch in each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _strings(batch, window, gram)
            if found is not None:
                _, first = np.unique(found[6], return_index=True)
                part, n = np.unique((found[5][first] % np.uint64(parts)).astype(np.int64), return_counts=True)
                yield pa.record_batch([pa.array(part), pa.array(n.astype(np.int64))], names=["part", "n"])

    return run


def hottest(sizes: DataFrame, parts: int, least: int = HOT_STRINGS, share: int = HOT_SHARE) -> np.ndarray:
    """Parts with too many strings for one task, of rows (part, n); at most one in ``share``."""
    sizes = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    mean = sizes.agg(F.sum("n") / F.lit(parts)).scalar()
    hot = sizes.where((F.col("n") >= least) & (F.col("n") >= share * mean)).select("part")
    return np.sort(np.array([r.part for r in hot.collect()], np.int64))


def hot_parts(rows: DataFrame, parts: int, window: int, gram: int, least: int = HOT_STRINGS, share: int = HOT_SHARE) -> np.ndarray:
    """Parts of minimisers that too many strings of the batches share."""
    return hottest(rows.select("_row", "text").mapInArrow(_counted(parts, window, gram), "part long, n long"), parts, least, share)


def _one_by_one(data: np.ndarray, start: np.ndarray, end: np.ndarray, window: int):
    """Two hashes of each window of the given strings, and the string and place of each."""
    size = end - start
    at = np.concatenate([[0], np.cumsum(size)])
    text = data[C.ranges(start, size)]
    starts, ends, row_at = C.words(text, at)
    hashes = C.word_hashes(text, starts, ends)
    windows = np.diff(row_at) - window + 1
    place = C.ranges(row_at[:-1], windows)
    owner = np.repeat(np.arange(len(start)), windows)
    one = C.between(C.running(hashes), place, place + window)
    others = C.running(C.word_hashes(text, starts, ends, seed=1), C.OTHER_BASE)
    two = C.between(others, place, place + window, C.OTHER_INVERSE)
    return one, two, owner, place - row_at[owner]


def window_places(row: np.ndarray, begin: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows as (row, start, end), overlapping ones of a row joined."""
    order = np.lexsort((begin, row))
    row, begin = row[order], begin[order]
    cut = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (begin[1:] > begin[:-1] + window)])[: len(row)])
    last = np.concatenate([cut[1:], [len(row)]])[: len(cut)] - 1
    return row[cut], begin[cut], begin[last] + window


def same_windows(one: np.ndarray, two: np.ndarray, twice: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each different window, and whether it occurs more than once."""
    order = np.lexsort((two, one))
    fresh = np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])])[: len(one)]
    which = np.empty(len(one), np.int64)
    which[order] = np.cumsum(fresh) - 1
    return which, np.bincount(which, weights=1 + twice) > 1


def settled_windows(parts: list[dict], window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of the windows that travelled one by one and repeat."""
    windows = [p for p in parts if "one" in p]
    if windows:
        one, two, row, begin, twice = (np.concatenate([p[k] for p in windows]) for k in ("one", "two", "row", "begin", "twice"))
        which, many = same_windows(one, two, twice)
        hit = many[which] & ~twice
        if hit.any():
            yield window_places(row[hit], begin[hit], window)


def _packed(buckets: int, hot: np.ndarray, window: int, gram: int):
    """Arrow batches of (_row, text) to rows (bucket, blob)."""
    parts = np.uint64(buckets * PARTS)

    def split(bucket: np.ndarray):
        order = np.argsort(bucket, kind="stable")
        return np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _strings(batch, window, gram)
            if found is None:
                continue
            data, row, begin, size, windows, key, whole, start, end = found
            first, same, count = C.exact_groups(whole, lambda i: b" ".join(data[start[i] : end[i]].tobytes().split()))
            again = count[same] > 1
            spans = [(row[again], begin[again], (begin + size)[again])]
            out: list[tuple[int, bytes]] = []
            dealt = np.isin((key[first] % parts).astype(np.int64), hot)
            alone, few = np.flatnonzero(dealt), np.flatnonzero(~dealt)
            bucket = (key[first[few]] % np.uint64(buckets)).astype(np.int64)
            for group in split(bucket):
                pick = first[few[group]]
                text = b"\n".join(b" ".join(data[a:b].tobytes().split()) for a, b in zip(start[pick], end[pick]))
                twice = count[few[group]] > 1
                out.append((int(bucket[group[0]]), C.pack(text=text, key=key[pick], row=row[pick], begin=begin[pick].astype(np.int32), size=size[pick].astype(np.int32), twice=twice)))
            if len(alone):
                pick = first[alone]
                one, two, owner, offset = _one_by_one(data, start[pick], end[pick], window)
                own, place, twice = row[pick][owner], begin[pick][owner] + offset, count[alone][owner] > 1
                which, many = same_windows(one, two, twice)
                hit = many[which]
                spans.append(window_places(own[hit], place[hit], window))
                _, keep = np.unique(which, return_index=True)
                one, two, own, place, twice = one[keep], two[keep], own[keep], place[keep], hit[keep]
                bucket = (one % np.uint64(buckets)).astype(np.int64)
                for group in split(bucket):
                    out.append((int(bucket[group[0]]), C.pack(one=one[group], two=two[group], row=own[group], begin=place[group], twice=twice[group])))
            done, a, b = map(np.concatenate, zip(*spans))
            out.append((int(C.mix(row[:1].astype(np.uint64))[0] % np.uint64(buckets)), C.pack(row=done, start=a.astype(np.int32), end=b.astype(np.int32))))
            yield pa.record_batch([pa.array([k for k, _ in out], pa.int32()), pa.array([v for _, v in out], pa.binary())], names=["bucket", "blob"])

    return run


def _repeated(ids: np.ndarray, at: np.ndarray, group: np.ndarray, twice: np.ndarray, window: int) -> list[np.ndarray]:
    """For each string, which of its windows repeat: windows are sorted by hash, then compared word by word."""
    windows = np.diff(at) - window + 1
    place = C.ranges(at[:-1], windows)
    owner = np.repeat(np.arange(len(windows)), windows)
    prefix = C.running(C.mix(ids.astype(np.uint64) + np.uint64(1)))
    order_key = C.between(prefix, place, place + window) ^ group[owner]
    order = np.argsort(order_key, kind="stable")
    flag = np.zeros(len(place), bool)
    key = order_key[order]
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.concatenate([cut, [len(key)]]))
    shared = np.flatnonzero(sizes > 1)
    span = np.arange(window)
    for few in np.array_split(shared, max(1, int(sizes[shared].sum()) // 50_000)) if len(shared) else []:
        member = order[C.ranges(cut[few], sizes[few])]
        run = np.repeat(np.arange(len(few)), sizes[few])
        rows = np.ascontiguousarray(ids[place[member][:, None] + span])
        head = np.concatenate([[0], np.cumsum(sizes[few])[:-1]])
        if (rows == rows[head][run]).all():
            flag[member] = True
        else:  # two texts with one hash: sort the words themselves
            _, same, count = np.unique(np.column_stack([run, rows]), axis=0, return_inverse=True, return_counts=True)
            flag[member] = count[same.ravel()] > 1
    flag |= twice[owner]
    return np.split(flag, np.cumsum(windows)[:-1])


def _settle(parts: list[dict], window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places (row, first word, word after the last) of one bucket that repeat."""
    for p in parts:
        if "start" in p and len(p["row"]):
            yield p["row"], p["start"].astype(np.int64), p["end"].astype(np.int64)
    yield from settled_windows(parts, window)
    parts = [p for p in parts if "text" in p]
    if not parts:
        return
    key, row, begin, size, twice = (np.concatenate([p[k] for p in parts]) for k in ("key", "row", "begin", "size", "twice"))
    texts = [t for p in parts for t in p["text"].split(b"\n")]
    _, same, count = np.unique(key, return_inverse=True, return_counts=True)
    keep = np.flatnonzero(count[same] > 1)  # the rest has no window in common with anything
    keep = keep[np.argsort(same[keep], kind="stable")]
    begin, size = begin.astype(np.int64), size.astype(np.int64)
    for group in _by_key(keep, same[keep], 20_000):
        seen: dict[bytes, int] = {}
        which = np.array([seen.setdefault(texts[i], len(seen)) for i in group])
        total = np.bincount(which, weights=1 + twice[group])
        equal = total[which] >= 2
        hit = group[equal & ~twice[group]]
        if len(hit):
            yield row[hit], begin[hit], begin[hit] + size[hit]
        kinds, first = np.unique(which, return_index=True)
        _, of_key, kinds_of_key = np.unique(same[group[first]], return_inverse=True, return_counts=True)
        mixed = kinds_of_key[of_key] > 1  # strings of a minimiser that has several
        if not mixed.any():
            continue
        pick = group[first[mixed]]
        known: dict[bytes, int] = {}
        lists = [[known.setdefault(w, len(known)) for w in texts[i].split(b" ")] for i in pick]
        at = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
        flags = _repeated(np.concatenate(lists).astype(np.int32), at, key[pick], total[kinds[mixed]] >= 2, window)
        for i, mark, n in zip(pick, flags, total[kinds[mixed]]):
            if n < 2 and mark.any():
                j = np.flatnonzero(mark)
                a, b = C.union(begin[i] + j, begin[i] + j + window)
                yield np.full(len(a), row[i]), a, b


def _by_key(index: np.ndarray, key: np.ndarray, about: int) -> Iterator[np.ndarray]:
    """Slices of about so many entries that never part a key."""
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    start = 0
    while start < len(index):
        later = cut[cut >= start + about]
        end = int(later[0]) if len(later) else len(index)
        yield index[start:end]
        start = end


def by_bucket(settle):
    """Arrow batches of (bucket, blob), sorted by bucket, to rows (_row, start, end)."""

    def emit(parts):
        found = list(settle(parts))
        if found:
            row, start, end = (np.concatenate(x) for x in zip(*found))
            yield pa.record_batch([pa.array(row.astype(np.int64)), pa.array(start.astype(np.int64)), pa.array(end.astype(np.int64))], names=["_row", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if bucket != now and parts:
                    yield from emit(parts)
                    parts = []
                now = bucket
                parts.append(C.unpack(blob.as_buffer()))
        if parts:
            yield from emit(parts)

    return run


def joined_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Each row with its spans; the texts stream past a hash table of spans, unsorted."""
    grouped = spans.groupBy("_row").agg(F.collect_list(F.struct("start", "end")).alias("_spans"))
    return rows.join(grouped.hint("shuffle_hash"), "_row", "left")


def repeated_spans(rows: DataFrame, window: int = WINDOW, gram: int = GRAM, least: int = HOT_STRINGS, share: int = HOT_SHARE) -> DataFrame:
    """(_row, start, end) in words, of rows (_row, text). ``least`` and ``share`` say which parts are hot."""
    n = C.partitions(rows.sparkSession)
    buckets = n * BUCKETS_PER_PARTITION
    hot = hot_parts(rows, buckets * PARTS, window, gram, least, share)
    packed = rows.select("_row", "text").mapInArrow(_packed(buckets, hot, window, gram), "bucket int, blob binary")
    dealt = packed.repartition(n, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(by_bucket(lambda parts: _settle(parts, window)), "_row long, start long, end long")


def kept_words(text: str | None, spans) -> tuple[int, int, str]:
    """Words, removed words and what is left, joined by one space."""
    found = (text or "").encode().split()
    mask = np.ones(len(found), bool)
    for s in spans or ():
        mask[s["start"] : s["end"]] = False
    left = found if mask.all() else [found[i] for i in np.flatnonzero(mask)]
    return len(found), len(found) - len(left), b" ".join(left).decode()


def trimmed(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` with the words left, joined by one space; a text that loses nothing stays as it is.

    ``n_chars``, where there is one, follows a changed text.
    """
    others = [c for c in docs.columns if c != "text"]
    filler = "_none"  # a struct needs a field
    while filler in others:
        filler += "_"
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "text", F.struct(F.lit(0).alias(filler), *map(C.quoted, others)).alias("_rest"))

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            out = [kept_words(t, s) if s else (0, 0, t) for t, s in zip(texts, batch.column("_spans").to_pylist())]
            yield pa.record_batch([pa.array([o[2] for o in out], pa.string()), pa.array([o[1] > 0 for o in out], pa.bool_()), batch.column("_rest")], names=["text", "_cut", "_rest"])

    joined = joined_spans(rows, repeated_spans(rows.select("_row", "text"), window, gram)).select("text", "_spans", "_rest")
    done = joined.mapInArrow(run, T.StructType().add("text", "string").add("_cut", "boolean").add("_rest", joined.schema["_rest"].dataType))
    own = {c: F.col("_rest").getField(c) for c in others} | {"text": F.col("text")}
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("_cut"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(own["n_chars"])
    return done.select(*[own[c].alias(c) for c in docs.columns])


def digest(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of ``docs``."""
    rows = C.with_row(docs, "doc_id", "text")

    def run(batches):
        for batch in batches:
            out = [kept_words(t, s) for t, s in zip(batch.column("text").to_pylist(), batch.column("_spans").to_pylist())]
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([hashlib.sha256(o[2].encode()).hexdigest() for o in out], pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    joined = joined_spans(rows, repeated_spans(rows, window, gram))
    kind = joined.schema["doc_id"].dataType.simpleString()
    return joined.select("doc_id", "text", "_spans").mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")
