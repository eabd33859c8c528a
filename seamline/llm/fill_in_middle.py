"""Fill-in-middle transformation by displacement scatter.

A text is cut into units of one line each (the line feed belongs to its line). Two
cuts drawn from the hash of its id part it into prefix, middle and suffix, which are
put out in another order behind sentinels, so that a left-to-right model learns to
fill a gap. A further draw keeps some texts plain, another picks the order:

    psm   <P>prefix<S>suffix<M>middle
    spm   <S>suffix<P>prefix<M>middle

The bytes of many texts are moved at once. A scan of the line feeds finds the cuts;
each part's shift against its place in the input is written as a difference at its
first byte; the cumulative sum of these differences is the shift of every byte, and
one scatter builds all outputs of the slice. ``restored`` knows an output and its
form only: it scans for the sentinels, builds the same kind of array for places of
the text, and gathers the bytes back.

A task holds one Arrow batch and the arrays of one slice of about ``SLICE_BYTES``
bytes; a longer text is a slice by itself, with about 20 bytes of memory a byte.

Defined cases: a null text is empty. Empty texts, and texts that hold a sentinel, stay
plain, since their output could not be told apart. Draws depend on the id alone, so
rows that repeat give the same rows again; a null id draws like an empty one. Units
number at least one in a text that isn't empty, and equal cuts leave the middle empty.
Columns other than the id and the text are not read. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.llm import common as C

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
FORMS = np.array(["plain", "psm", "spm"])
LINE_FEED = 10
#: Share in a hundred of the texts that are cut, and of these that put the suffix first.
CUT_SHARE, SUFFIX_FIRST_SHARE, SEED = 100, 50, 7


def draws(key: Column, seed: int = SEED) -> list[Column]:
    """Four numbers below 2 ** 32 from the hash of the seed and a key as text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def found(data: np.ndarray, mark: bytes, at: np.ndarray) -> np.ndarray:
    """Places of ``mark`` that lie in one row each; rows begin at ``at``."""
    place = np.flatnonzero(data == mark[0])
    place = place[place + len(mark) <= len(data)]
    for k in range(1, len(mark)):
        place = place[data[place + k] == mark[k]]
    return place[place + len(mark) <= at[np.searchsorted(at, place, "right")]]


def rows_of(place: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(at, place, "right") - 1


def shifts(start: np.ndarray, shift: np.ndarray, size: int) -> np.ndarray:
    """Shift of each of ``size`` bytes: parts follow each other, and part k moves by ``shift[k]``.

    Empty parts begin where the next one does; their differences add up there.
    """
    change = np.diff(shift, prepend=0)
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, start, change)
    return np.cumsum(steps[:-1])


def code_points(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Code points between byte places."""
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return before[end] - before[start]


def scattered(data: np.ndarray, at: np.ndarray, h: list[np.ndarray], cut_share: int, suffix_first: int):
    """Outputs of the rows: bytes, row starts, units, form (0 plain, 1 psm, 2 spm), prefix and middle in code points."""
    rows, size = len(at) - 1, np.diff(at)
    feeds = np.flatnonzero(data == LINE_FEED)
    feed_at = np.searchsorted(feeds, at)
    ended = np.zeros(rows, bool)
    filled = size > 0
    ended[filled] = data[at[1:][filled] - 1] == LINE_FEED
    units = np.diff(feed_at) + (filled & ~ended)

    form = np.where(filled & (h[2] % 100 < cut_share), np.where(h[3] % 100 < suffix_first, 2, 1), 0)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        form[rows_of(found(data, mark, at), at)] = 0

    one, two = h[0] % (units + 1), h[1] % (units + 1)
    cuts = []
    for k in (np.minimum(one, two), np.maximum(one, two)):
        # The k-th line ends at its feed; the last one may end with the text.
        last = feeds[np.minimum(feed_at[:-1] + k - 1, max(len(feeds) - 1, 0))] + 1 if len(feeds) else at[1:]
        cuts.append(np.where(k == 0, at[:-1], np.where(k > np.diff(feed_at), at[1:], last)))
    low, high = cuts
    plain = form == 0
    low, high = np.where(plain, at[:-1], low), np.where(plain, at[:-1], high)

    marks = np.where(plain, 0, len(PREFIX))
    out_at = np.concatenate([[0], np.cumsum(size + 3 * marks)])
    prefix, middle, suffix = low - at[:-1], high - low, at[1:] - high
    # Where the parts go, in the order in which they lie in the input.
    spm = form == 2
    to_prefix = out_at[:-1] + np.where(spm, 2 * marks + suffix, marks)
    to_suffix = out_at[:-1] + np.where(spm | plain, marks, 2 * marks + prefix)
    to_middle = out_at[:-1] + 3 * marks + prefix + suffix
    start = np.column_stack([at[:-1], low, high]).ravel()
    shift = np.column_stack([to_prefix, to_middle, to_suffix]).ravel() - start
    out = np.empty(out_at[-1], np.uint8)
    out[np.arange(len(data)) + shifts(start, shift, len(data))] = data
    cut = ~plain
    for mark, place in ((PREFIX, to_prefix), (SUFFIX, to_suffix), (MIDDLE, to_middle)):
        out[(place[cut] - len(mark))[:, None] + np.arange(len(mark))] = np.frombuffer(mark, np.uint8)
    return out, out_at, units, form, code_points(data, at[:-1], low), code_points(data, low, high)


def gathered(data: np.ndarray, at: np.ndarray, form: np.ndarray):
    """Texts of outputs: bytes and row starts. A cut output holds each sentinel once."""
    plain = form == 0
    place = []
    for mark in (PREFIX, SUFFIX, MIDDLE):
        here = found(data, mark, at)
        owner = rows_of(here, at)
        first = np.full(len(form), -1, np.int64)
        first[owner[::-1]] = here[::-1]
        place.append(first)
    if any((p[~plain] < 0).any() for p in place):
        raise ValueError("a sentinel is missing from an output")
    p, s, m = place
    width = len(PREFIX)
    spm = form == 2
    begin = [np.where(plain, at[:-1], p + width), np.where(plain, at[1:], m + width), np.where(plain, at[1:], s + width)]
    end = [np.where(plain, at[1:], np.where(spm, m, s)), at[1:], np.where(plain, at[1:], np.where(spm, p, m))]
    sizes = np.column_stack([b - a for a, b in zip(begin, end)])
    text_at = np.concatenate([[0], np.cumsum(sizes.sum(axis=1))])
    start = (text_at[:-1, None] + np.cumsum(sizes, axis=1) - sizes).ravel()
    shift = np.column_stack(begin).ravel() - start
    return data[np.arange(text_at[-1]) + shifts(start, shift, int(text_at[-1]))], text_at


def strings(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """A string column over bytes and row starts."""
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())


def _transformed(cut_share: int, suffix_first: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = C.text_buffer(batch.column("text"))
            h = [batch.column(f"h{i}").to_numpy() for i in range(1, 5)]
            for i, j in C.slices(at):
                out, out_at, units, form, prefix, middle = scattered(data[at[i] : at[j]], at[i : j + 1] - at[i], [x[i:j] for x in h], cut_share, suffix_first)
                plain = form == 0
                yield pa.record_batch(
                    [batch.column(0).slice(i, j - i), pa.array(units.astype(np.int64)), pa.array(FORMS[form].tolist(), pa.string()), pa.array(prefix.astype(np.int64), mask=plain), pa.array(middle.astype(np.int64), mask=plain), strings(out, out_at)],
                    names=["_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return run


def transform(docs: DataFrame, key: str = "doc_id", cut_share: int = CUT_SHARE, suffix_first: int = SUFFIX_FIRST_SHARE, seed: int = SEED) -> DataFrame:
    """The id, n (units), form, prefix_chars, middle_chars and output of each row of ``docs``."""
    rows = docs.select(F.col(key).alias("_id"), "text", *draws(F.col(key), seed))
    kind = rows.schema["_id"].dataType.simpleString()
    done = rows.mapInArrow(_transformed(cut_share, suffix_first), f"_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return done.withColumnRenamed("_id", key)


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = C.text_buffer(batch.column("output"))
        form = np.searchsorted(FORMS, batch.column("form").to_numpy(zero_copy_only=False).astype(str))
        for i, j in C.slices(at):
            text, text_at = gathered(data[at[i] : at[j]], at[i : j + 1] - at[i], form[i:j])
            rest = batch.slice(i, j - i)
            yield pa.record_batch([*rest.columns, strings(text, text_at)], names=[*rest.schema.names, "restored"])


def restored(outputs: DataFrame) -> DataFrame:
    """``outputs`` with the text rebuilt from ``output`` and ``form`` alone, as ``restored``."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in outputs.schema.fields)
    return outputs.mapInArrow(_restored, f"{fields}, restored string")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the hashes of the output and of the text rebuilt from it."""
    done = restored(transform(docs))
    hashes = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *hashes)
