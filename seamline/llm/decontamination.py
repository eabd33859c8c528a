"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are compared byte by byte with A-Z lowered and white space as spaces. An item
of n bytes occurs when a part of the document can be made into it by at most e
edits, e = RATE * n. Such a part shares at least n - Q + 1 - Q * e of the item's
q-grams, on diagonals (place in the text less place in the item) that differ by at
most e. Diagonal bands of width 2 (e + 1), one at each e + 1, hold all of them in
one band. Bands with enough shared q-grams are verified by alignment within the
band; nothing else is dropped or kept.

The q-grams of the benchmark are broadcast in blocks of at most ``BLOCK_BYTES`` of
item text (or one item), one pass over the documents a block, so what is
broadcast is bounded however large the benchmark is. An item too short for the
budget gets a smaller one, an item below Q bytes must occur exactly, an empty or
null item occurs nowhere. Null and empty documents hold nothing. Null and repeated
ids are kept; a repeated row gives its own hits. Further columns are never read;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm import common as C
from seamline.llm.suffix_dedup import _symbols

Q, RATE, BLOCK_BYTES = 8, 0.1, 1 << 20
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[[9, 10, 11, 12, 13]] = 32
_BITS = 20


def plain(raw: bytes) -> np.ndarray:
    return _PLAIN[np.frombuffer(raw, np.uint8)]


class Index:
    """Q-grams of some items: sorted grams, their places, and a bitmap that most other grams miss."""

    def __init__(self, items: list[tuple[object, str]]):
        self.ids = [i for i, _ in items]
        self.texts = [plain(t.encode()) for _, t in items]
        size = np.array([len(t) for t in self.texts], np.int64)
        self.edits = np.maximum(0, np.minimum((size * RATE).astype(np.int64), (size - Q) // Q))
        self.least = np.maximum(1, size - Q + 1 - Q * self.edits)
        self.short = [k for k in range(len(items)) if 0 < size[k] < Q]
        grams = [_symbols(t) for t in self.texts]
        flat = np.concatenate([*grams, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(items)), [len(g) for g in grams])
        place = C.ranges(np.zeros(len(items), np.int64), np.array([len(g) for g in grams], np.int64))
        order = np.argsort(flat, kind="stable")
        self.grams, self.count = np.unique(flat, return_counts=True)
        self.first = np.cumsum(self.count) - self.count
        self.item, self.place = item[order], place[order]
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[self._slot(self.grams)] = True

    @staticmethod
    def _slot(grams: np.ndarray) -> np.ndarray:
        return (grams * C.ODD) >> np.uint64(64 - _BITS)

    def bands(self, text: np.ndarray, at: np.ndarray) -> np.ndarray:
        """[row, item, band] of the bands that share enough q-grams."""
        none = np.zeros((0, 3), np.int64)
        if len(text) < Q or not len(self.grams):
            return none
        grams = _symbols(text)
        place = np.flatnonzero(self.bitmap[self._slot(grams)])
        found = np.minimum(np.searchsorted(self.grams, grams[place]), len(self.grams) - 1)
        hit = self.grams[found] == grams[place]
        place, found = place[hit], found[hit]
        row = np.searchsorted(at, place, "right") - 1
        inside = place + Q <= at[row + 1]
        place, found, row = place[inside], found[inside], row[inside]
        # A row and item with fewer hits than the item needs in one band can be passed over.
        entry = C.ranges(self.first[found], self.count[found])
        times = self.count[found]
        row, item = np.repeat(row, times), self.item[entry]
        key = row * len(self.ids) + item
        order = np.argsort(key, kind="stable")
        fresh = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]])) if len(key) else np.zeros(0, np.int64)
        sizes = np.diff(np.concatenate([fresh, [len(key)]])) if len(key) else fresh
        enough = np.repeat(sizes >= self.least[item[order[fresh]]], sizes) if len(key) else np.zeros(0, bool)
        keep = order[enough]
        if not len(keep):
            return none
        place, row, item, own = np.repeat(place, times)[keep], row[keep], item[keep], self.place[entry][keep]
        band = (place - at[row] - own) // (self.edits[item] + 1)
        row, item, own = np.tile(row, 2), np.tile(item, 2), np.tile(own, 2)
        band = np.concatenate([band, band - 1])
        order = np.lexsort((own, band, item, row))
        row, item, band, own = row[order], item[order], band[order], own[order]
        group = np.concatenate([[True], (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])])
        distinct = group | np.concatenate([[True], own[1:] != own[:-1]])
        head = np.flatnonzero(group)
        shared = np.add.reduceat(distinct.astype(np.int64), head)
        good = head[shared >= self.least[item[head]]]
        return np.column_stack([row[good], item[good], band[good]])


def aligned(item: np.ndarray, parts: list[np.ndarray], edits: int, width: int) -> list[tuple[int, int, int] | None]:
    """(edits, start, end) of the best place of ``item`` in each part, on diagonals 0 to width - 1, if within the budget.

    All parts are aligned together; one step of the item takes one vector
    operation over the band. A cell holds cost and start in one number.
    """
    wide, one = width + 2 * edits, 1 << 32
    text = np.zeros((len(parts), len(item) + wide + 1), np.int16) - 1
    for k, p in enumerate(parts):
        text[k, edits : edits + len(p)] = p[: text.shape[1] - edits]
    lane = np.arange(wide, dtype=np.int64)
    step = lane * one
    inside = (lane >= edits) & (lane < edits + width)
    high = (len(item) + 1) * 4 * one
    cost = np.where(inside, lane, high)[None, :].repeat(len(parts), 0)
    for i, c in enumerate(item.tolist()):
        moved = cost + (text[:, i : i + wide] != c) * one
        moved[:, :-1] = np.minimum(moved[:, :-1], cost[:, 1:] + one)
        cost = np.minimum.accumulate(moved - step, axis=1) + step
    end = cost.argmin(axis=1)
    best = cost[np.arange(len(parts)), end]
    out = []
    for b, e in zip(best.tolist(), end.tolist()):
        out.append((b >> 32, (b & (one - 1)) - edits, len(item) + e - edits) if b >> 32 <= edits else None)
    return out


def occurrences(index: Index, text: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """row, item, start, end, edits of each place of an item; overlapping places of an item count once."""
    found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    waiting: dict[int, list[tuple[int, int, np.ndarray]]] = {}
    for row, item, band in index.bands(text, at).tolist():
        e, own = int(index.edits[item]), index.texts[item]
        start = max(0, band * (e + 1))
        width = band * (e + 1) + 2 * (e + 1) - start
        part = text[at[row] + start : min(at[row + 1], at[row] + start + width + len(own) + e)]
        exact = part.tobytes().find(own.tobytes()) if width > 0 else -1
        if exact >= 0:
            found.setdefault((row, item), []).append((0, start + exact, start + exact + len(own)))
        elif width > 0 and e:
            waiting.setdefault(item, []).append((row, start, part))
    for item, places in waiting.items():
        e = int(index.edits[item])
        for k in range(0, len(places), 256):
            few = places[k : k + 256]
            for (row, start, _), hit in zip(few, aligned(index.texts[item], [p for _, _, p in few], e, 2 * (e + 1))):
                if hit:
                    found.setdefault((row, item), []).append((hit[0], start + max(0, hit[1]), start + hit[2]))
    for k in index.short:
        own = index.texts[k].tobytes()
        raw = text.tobytes()
        for row in range(len(at) - 1):
            place = raw.find(own, at[row], at[row + 1])
            while place >= 0:
                found.setdefault((row, k), []).append((0, place - int(at[row]), place - int(at[row]) + len(own)))
                place = raw.find(own, place + len(own), at[row + 1])
    for (row, item), hits in found.items():
        taken: list[tuple[int, int]] = []
        for e, a, b in sorted(hits):
            if all(b <= c or a >= d for c, d in taken):
                taken.append((a, b))
                yield row, item, a, b, e


def _hits(held, id_types: tuple[pa.DataType, pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = C.received(Index, held)
        for batch in batches:
            data, at = C.text_buffer(batch.column(2))
            rows, docs = batch.column(0).to_numpy(), batch.column(1)
            for i, j in C.slices(at):
                out = list(occurrences(index, _PLAIN[data[at[i] : at[j]]], at[i : j + 1] - at[i]))
                if out:
                    row, item, start, end, edits = zip(*out)
                    where = np.array(row) + i
                    yield pa.record_batch(
                        [pa.array(rows[where]), docs.take(pa.array(where)), pa.array([index.ids[k] for k in item], id_types[1]), *(pa.array(x, pa.int64()) for x in (start, end, edits))],
                        names=["_row", "doc_id", "item_id", "start", "end", "edits"],
                    )

    return run


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """_row, doc_id, item_id, start, end (bytes), edits of each place where an item occurs in a document."""
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text").where("length(text) > 0").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // BLOCK_BYTES))
    kinds = [docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()]
    types = tuple({"string": pa.string(), "int": pa.int32()}.get(k, pa.int64()) for k in kinds)
    schema = f"_row long, doc_id {kinds[0]}, item_id {kinds[1]}, start long, `end` long, edits long"
    rows, out = C.with_row(docs, "doc_id", "text"), None
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        held = C.sent(spark, Index([(r.item_id, r.text) for r in part]))
        found = rows.mapInArrow(_hits(held, types), schema)
        out = found if out is None else out.unionAll(found)
    return out


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that hold an item."""
    found = hits(docs, benchmark).select("_row").distinct()
    numbered = docs.select(F.monotonically_increasing_id().alias("_row"), C.as_struct(docs.columns).alias("_doc"))
    left = numbered.join(found.hint("shuffle_hash"), "_row", "left_anti")
    return left.select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns])
