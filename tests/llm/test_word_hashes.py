"""Words that a polynomial over bytes can't tell apart, through the operators that hash words."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seamline.llm import common as C
from seamline.llm import lm_scoring, minhash_dedup, substring_dedup


def thue_morse(first, second, doublings):
    a, b = first, second
    for _ in range(doublings):
        a, b = a + b, b + a
    return a, b


HALVES = tuple("".join(random.Random(k).choices("abc", k=65_536)) for k in range(2))
PAIRS = {"thue-morse": thue_morse("a", "b", 11), "swapped halves": (HALVES[0] + HALVES[1], HALVES[1] + HALVES[0])}


@pytest.mark.parametrize("kind", PAIRS)
def test_different_words_stay_different(spark, kind):
    one, two = PAIRS[kind]
    common = " ".join(f"w{k}" for k in range(34))
    docs = spark.createDataFrame([(1, f"{common} {one}"), (2, f"{common} {two}")], "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.digest(docs).collect()] == [0, 0]
    rows = docs.select(F.col("doc_id").alias("_row"), "text")
    assert substring_dedup.repeated_spans(rows, least=1, share=0).count() == 0  # all windows travel one by one
    alone = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in minhash_dedup.digest(alone).collect()) == [(1, 1), (2, 2)]
    scored = lm_scoring.score(alone, F.col("doc_id") == 2).where("held_out").first()
    assert scored.n_known == 1  # the end alone


def hashes_of(words, seed=0):
    data, at = C.text_buffer(pa.array([" ".join(words)]))
    return C.word_hashes(data, *C.words(data, at)[:2], seed=seed)


def test_hashes_follow_bytes_length_and_seed():
    r = random.Random(3)
    words = list({"".join(r.choice("ab\x00é") for _ in range(r.choice([1, 2, 7, 8, 9, 16, 17, 63, 64, 65, 200]))) for _ in range(3000)})
    one, two = hashes_of(words), hashes_of(words, 1)
    assert len(set(one.tolist())) == len(set(two.tolist())) == len(words)
    assert not np.intersect1d(one, two).size
    assert (hashes_of(words[::-1])[::-1] == one).all()


def test_texts_of_one_hash_are_told_apart():
    texts = [b"x", b"y", b"x", b"z", b"y", b"y"]
    first, same, count = C.exact_groups(np.array([5, 5, 5, 9, 5, 5], np.uint64), texts.__getitem__)
    assert sorted((texts[f], int(c)) for f, c in zip(first, count)) == [(b"x", 2), (b"y", 3), (b"z", 1)]
    assert all(texts[first[s]] == t for s, t in zip(same, texts))
