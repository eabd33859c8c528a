"""Bounded-space online packing of token ids into sequences.

Each partition keeps at most ``open_windows`` open windows. The part of a
document that fills whole sequences goes out as such. The rest goes to the open
window that it fills best; when none has room, the fullest is filled up with a cut
of it and emitted. At the end of a partition its open windows are leftovers.
Leftovers of ``MERGED`` partitions meet in one task, which packs them again and
cuts what still is not full into sequences whose length is a power of two, which
need no padding.

A task holds one Arrow batch and its open windows. Placed pieces are written once to
the shared folder, so the encoding is never repeated and a lost executor costs its
tasks only. A null text is empty and holds the end id alone; null and repeated ids are
kept, since a piece belongs to a row. Further columns are never read; an empty table
gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm import common as C
from seamline.llm.tokens import byte_bpe
from seamline.session import scratch

SIZE, OPEN_WINDOWS, MERGED = 1024, 16, 32


class Encoder:
    """Token ids of whole texts, by the vocabulary file's own rules."""

    def __init__(self, path: str):
        self.path, self._encode = path, byte_bpe(path).encode

    @cached_property
    def model(self):
        """The file in the library it was made for, to compare with."""
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(self.path)
        model.encode_special_tokens = True  # their strings in a text are ordinary text
        return model

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        for text in texts:
            yield np.array(self._encode(text), np.uint32)


class Window:
    __slots__ = ("used", "pieces")

    def __init__(self):
        self.used, self.pieces = 0, []


class Packer:
    """Open windows of one task. ``add`` and ``close`` give windows that are full."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.open = size, most, []

    def _put(self, window: Window, piece) -> Iterator[Window]:
        window.pieces.append(piece)
        window.used += len(piece[-1])
        if window.used == self.size:
            if window in self.open:
                self.open.remove(window)
            yield window

    def add(self, doc, start: int, total: int, ids: np.ndarray) -> Iterator[Window]:
        """Place ids of a document that begin at ``start`` of its ``total``."""
        while len(ids) >= self.size:
            yield from self._put(Window(), (doc, start, total, ids[: self.size]))
            start, ids = start + self.size, ids[self.size :]
        if not len(ids):
            return
        room = [w for w in self.open if w.used + len(ids) <= self.size]
        if room:
            yield from self._put(max(room, key=lambda w: w.used), (doc, start, total, ids))
            return
        if len(self.open) >= self.most:
            fullest = max(self.open, key=lambda w: w.used)
            cut = self.size - fullest.used
            yield from self._put(fullest, (doc, start, total, ids[:cut]))
            start, ids = start + cut, ids[cut:]
        fresh = Window()
        self.open.append(fresh)
        yield from self._put(fresh, (doc, start, total, ids))


def powers_of_two(windows: list[Window], size: int) -> Iterator[Window]:
    """The pieces of the windows in full sequences, then in ever smaller powers of two."""
    pieces = [p for w in windows for p in w.pieces]
    left = sum(len(p[-1]) for p in pieces)
    now, goal = Window(), 0
    while pieces:
        goal = goal or min(size, 1 << (left.bit_length() - 1))
        doc, start, total, ids = pieces.pop(0)
        take = ids[: goal - now.used]
        now.pieces.append((doc, start, total, take))
        now.used += len(take)
        if len(take) < len(ids):
            pieces.insert(0, (doc, start + len(take), total, ids[len(take) :]))
        if now.used == goal:
            left -= goal
            yield now
            now, goal = Window(), 0


NAMES = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids", "part", "group"]


def _batch(rows: list[tuple], doc_type: pa.DataType) -> pa.RecordBatch:
    kinds = [doc_type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 9, kinds)], names=NAMES)


def _rows(windows, number: int, part: int, group) -> Iterator[tuple]:
    for k, w in enumerate(windows):
        offset = 0
        for doc, start, total, ids in w.pieces:
            yield doc, start, len(ids), total, number + k, offset, ids.astype("<u4").tobytes(), part, group
            offset += len(ids)


def _placed(path: str, end_id: int, size: int, most: int, doc_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder, packer, number = Encoder(path), Packer(size, most), part << 40
        for batch in batches:
            docs = batch.column(0).to_pylist()
            for i in range(0, len(docs), 256):
                texts = [t or "" for t in batch.column(1).slice(i, 256).to_pylist()]
                done = []
                for doc, ids in zip(docs[i : i + 256], encoder.encode(texts)):
                    done.extend(packer.add(doc, 0, len(ids) + 1, np.append(ids, np.uint32(end_id))))
                if done:
                    yield _batch(list(_rows(done, number, part, None)), doc_type)
                    number += len(done)
        if packer.open:
            yield _batch(list(_rows(packer.open, number, part, part // MERGED)), doc_type)

    return run


def _merged(size: int, most: int, doc_type: pa.DataType):
    def close(rows: list[dict], group: int):
        windows: dict[int, Window] = {}
        for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
            w = windows.setdefault(r["sequence_id"], Window())
            w.pieces.append((r["doc_id"], r["start"], r["doc_tokens"], np.frombuffer(r["ids"], "<u4")))
            w.used += r["length"]
        packer, done = Packer(size, most), []
        for w in sorted(windows.values(), key=lambda w: -w.used):
            for piece in w.pieces:
                done.extend(packer.add(*piece))
        done.extend(powers_of_two(packer.open, size))
        return _batch(list(_rows(done, (1 << 62) | (group << 40), group, None)), doc_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if rows and r["group"] != now:
                    yield close(rows, now)
                    rows = []
                now = r["group"]
                rows.append(r)
        if rows:
            yield close(rows, now)

    return run


def pack(docs: DataFrame, path: str, end_id: int = 0, size: int = SIZE, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """One row a piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian 32-bit)."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    doc_type = pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()
    schema = f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary, part long, `group` long"
    to = scratch(spark, "packed")
    docs.select("doc_id", "text").mapInArrow(_placed(path, end_id, size, open_windows, doc_type), schema).write.option("compression", "zstd").parquet(to)
    placed = spark.read.schema(schema).parquet(to)
    left = placed.where(F.col("group").isNotNull()).repartition(C.partitions(spark), "group").sortWithinPartitions("group")
    merged = left.mapInArrow(_merged(size, open_windows, doc_type), schema)
    return placed.where(F.col("group").isNull()).union(merged).select(*NAMES[:7])


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the crc32 of their ids instead of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
