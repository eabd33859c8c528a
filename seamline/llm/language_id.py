"""Language identification by bit-sliced Bloom filters of n-grams.

Training counts the byte trigrams of each language (A-Z lowered, white space and
digits as spaces) over all its texts. A trigram belongs to a language when it makes
up at least ``RARE`` of the language's trigrams and at least ``SHARE`` of what it makes up
in the language that uses it most; so a language has at most 1 / RARE members and
the filter's size is bounded, whatever the corpus. The filter is bit-sliced: each
slot holds one bit a language, and the AND of a trigram's slots gives all
languages that contain it. A text's popcount of each language is corrected for the
filter's false positives; the highest decides.

Null texts and texts without a letter are ``und`` with score 0. A text none of whose
trigrams is known gets the commonest language with score 0; ties go to the language
first in order. Rows whose language is null teach nothing. Rows with a null id are
learned from. Repeated rows count each time. Without any training row all texts are
``und``. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.llm import common as C

RARE, SHARE, SLOT_BITS, PROBES = 1e-5, 0.3, 20, 3
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[48:58] = 32
_FOLD[:33] = 32


def trigrams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and 24-bit code of all trigrams but blank ones; a text begins and ends with a space."""
    size = np.diff(at) + 2
    padded = np.full(int(size.sum()), 32, np.uint32)
    begin = np.cumsum(size) - size
    padded[C.ranges(begin + 1, size - 2)] = _FOLD[data]
    if len(padded) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    code = (padded[:-2] << 16) | (padded[1:-1] << 8) | padded[2:]
    row = np.repeat(np.arange(len(size)), size)[:-2]
    good = (row == np.repeat(np.arange(len(size)), size)[2:]) & (code != 0x202020)
    return row[good], code[good]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, gram, n) of each batch."""
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        data, at = C.text_buffer(batch.column(1))
        seen: dict[str, np.ndarray] = {}
        for i, j in C.slices(at):
            row, code = trigrams(data[at[i] : at[j]], at[i : j + 1] - at[i])
            for lang in set(langs[i:j]):
                own = np.bincount(code[(langs[i:j] == lang)[row]], minlength=1 << 24).astype(np.uint32)
                if lang in seen:
                    seen[lang] += own
                else:
                    seen[lang] = own
                if len(seen) > 4:
                    yield _said(*seen.popitem())
        for lang, counts in seen.items():
            yield _said(lang, counts)


def _said(lang: str, counts: np.ndarray) -> pa.RecordBatch:
    gram = np.flatnonzero(counts)
    return pa.record_batch([pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int32)), pa.array(counts[gram].astype(np.int64))], names=["lang", "gram", "n"])


def members(rows: DataFrame) -> tuple[list[str], list]:
    """Languages, the commonest first, and (lang, gram) of the filter's members."""
    counts = rows.mapInArrow(_counted, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = C.cut_lineage(counts)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    parts = counts.join(totals, "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("part")).where(F.col("part") >= RARE)
    most = parts.groupBy("gram").agg(F.max("part").alias("most"))
    kept = parts.join(most, "gram").where(F.col("part") >= SHARE * F.col("most")).select("lang", "gram")
    langs = [r.lang for r in totals.orderBy(F.desc("total"), "lang").collect()]
    return langs, kept.collect()


class Filter:
    """Slots of one bit a language."""

    def __init__(self, langs: list[str], kept: list):
        self.langs = langs
        self.slots = np.zeros((1 << SLOT_BITS, max(1, -(-len(langs) // 64))), np.uint64)
        number = {lang: k for k, lang in enumerate(langs)}
        lang = np.array([number[r.lang] for r in kept], np.int64)
        gram = np.array([r.gram for r in kept], np.uint32)
        for slot in self._probes(gram):
            np.bitwise_or.at(self.slots, (slot, lang // 64), np.uint64(1) << (lang % 64).astype(np.uint64))
        self.false = np.array([self._bit(self.slots, k).mean() ** PROBES for k in range(len(langs))])

    @staticmethod
    def _probes(gram: np.ndarray) -> Iterator[np.ndarray]:
        for p in range(1, PROBES + 1):
            seed = np.uint64(p * 0x632BE59BD9B4E019 % (1 << 64))
            yield (C.mix(gram.astype(np.uint64) + seed) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    @staticmethod
    def _bit(words: np.ndarray, lang: int) -> np.ndarray:
        return (words[:, lang // 64] >> np.uint64(lang % 64)) & np.uint64(1)

    def predict(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the language and share of the corrected popcounts of each row."""
        row, code = trigrams(data, at)
        known, inverse = np.unique(code, return_inverse=True)  # each trigram is probed once
        word = None
        for slot in self._probes(known):
            word = self.slots[slot] if word is None else word & self.slots[slot]
        n = np.bincount(row, minlength=len(at) - 1)
        hits = np.stack([np.bincount(row, self._bit(word, k)[inverse], len(at) - 1) for k in range(len(self.langs))])
        right = np.maximum(0, hits - self.false[:, None] * n) / (1 - self.false[:, None])
        best, total = right.argmax(axis=0), right.sum(axis=0)
        return best, np.where(total > 0, right.max(axis=0) / np.where(total > 0, total, 1), 0.0)


def identify(docs: DataFrame, held_out: Column) -> DataFrame:
    """_row, doc_id, held_out, lang_pred, score for each row of ``docs``; learns from rows that are not held out."""
    spark = docs.sparkSession
    train = docs.where(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text")
    held = C.sent(spark, Filter(*members(train)))
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", held_out.alias("held_out"), F.when(letters, F.col("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = C.received(Filter, held)
        for batch in batches:
            data, at = C.text_buffer(batch.column(3))
            lang, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            there = batch.column(3).is_valid().to_numpy(zero_copy_only=False)
            for i, j in C.slices(at) if known.langs else ():
                best, share = known.predict(data[at[i] : at[j]], at[i : j + 1] - at[i])
                score[i:j] = np.where(there[i:j], share, 0.0)
                lang[i:j] = [known.langs[b] if t else "und" for b, t in zip(best, there[i:j])]
            yield pa.record_batch([*(batch.column(k) for k in range(3)), pa.array(lang, pa.string()), pa.array(score)], names=["_row", "doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_row long, doc_id {kind}, held_out boolean, lang_pred string, score double")
