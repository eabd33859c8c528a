"""Operators on texts against brute force, on a table with every awkward row."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seamline.llm import common as C
from seamline.llm import chat_format, decontamination, embedding_dedup, language_id, lm_scoring, minhash_dedup, packing, substring_dedup, suffix_dedup, toxicity
from seamline.llm.queries import crc_is, tokenizer_path

rng = random.Random(5)
WORDS = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(400)]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


PASSAGE = prose(60)
LONG = prose(30_000)
BASE = prose(200).split()


def near(k):
    words = list(BASE)
    for i in rng.sample(range(200), k):
        words[i] = f"edit{rng.random()}"
    return " ".join(words)


TEXTS = [
    None, "", " \t\n", "one", "One two  three", "one two three", PASSAGE, f"{prose(9)}\n{PASSAGE}\t{prose(80)}", f"{prose(50)} {PASSAGE}",
    LONG, LONG, "x" * 3000, "ab " * 900, "a b  c\x0bd", "\x00null\x00", "Naïve  \n \n text ", *[near(k) for k in (0, 1, 2, 3, 4, 5, 6)], *[prose(rng.randint(1, 300)) for _ in range(30)],
]
ROWS = [(i, t, ["en", "de", None][i % 3], "s", len(t or "")) for i, t in enumerate(TEXTS)]
ROWS += [ROWS[7], (None, PASSAGE + " " + PASSAGE, "en", "s", 0)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    extra = {"_row": F.lit(1), "start": F.lit("x"), "key": F.lit(None).cast("int"), "_spans": F.lit(2), "n": F.lit(0)}
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3, "n_chars").withColumns(extra)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same(df, want, *columns):
    got = collections.Counter(tuple(r[c] for c in columns) for r in df.collect())
    assert got == collections.Counter(want)


def raw(text):
    return (text or "").encode()


def test_hashes_of_words_do_not_depend_on_their_place():
    import pyarrow as pa

    each = []
    for text in ("one two", " \t one\n\ntwo ", "x one two"):
        data, at = C.text_buffer(pa.array([text]))
        each.append(C.word_hashes(data, *C.words(data, at)[:2])[-2:].tolist())
    assert each[0] == each[1] == each[2]


def test_substring_dedup_is_brute_force(docs, empty):
    found = [raw(t).split() for _, t, *_ in ROWS]
    window = 35
    count = collections.Counter(tuple(w[k : k + window]) for w in found for k in range(len(w) - window + 1))
    want = []
    for (doc, *_), w in zip(ROWS, found):
        gone = {j for k in range(len(w) - window + 1) if count[tuple(w[k : k + window])] > 1 for j in range(k, k + window)}
        left = b" ".join(x for j, x in enumerate(w) if j not in gone)
        want.append((doc, len(w), len(gone), hashlib.sha256(left).hexdigest()))
    same(substring_dedup.digest(docs), want, "doc_id", "n_words", "n_removed", "kept_sha256")
    assert substring_dedup.digest(empty).count() == 0
    trimmed = substring_dedup.trimmed(docs)
    assert trimmed.columns == docs.columns and trimmed.count() == len(ROWS)
    assert {r.text for r in trimmed.where("doc_id = 9").collect()} == {""}


def test_substring_dedup_gives_the_same_when_parts_are_hot(docs):
    def covered(spans):
        return {(r._row, k) for r in spans.collect() for k in range(r.start, r.end)}

    rows = C.with_row(docs, "text")
    want = covered(substring_dedup.repeated_spans(rows))
    parts = C.partitions(docs.sparkSession) * substring_dedup.BUCKETS_PER_PARTITION * substring_dedup.PARTS
    for least, share in ((1, 0), (2, 0), (3, 1)):
        assert len(substring_dedup.hot_parts(rows, parts, 35, 6, least, share))
        assert covered(substring_dedup.repeated_spans(rows, least=least, share=share)) == want
    # One phrase, each time in other words; two of the texts share more than it.
    phrase = " ".join(f"p{k}" for k in range(12))
    texts = [f"{' '.join(f'a{i}x{k}' for k in range(30))} {phrase} {' '.join(f'b{i}x{k}' for k in range(30))}" for i in range(60)]
    texts.append("new " + texts[5])
    docs = docs.sparkSession.createDataFrame(list(enumerate(texts)), "_row long, text string").repartition(5)
    for least, share in ((1, 0), (20, 0), (10**9, 16)):
        got = covered(substring_dedup.repeated_spans(docs, least=least, share=share))
        assert got == {(5, k) for k in range(72)} | {(60, k) for k in range(1, 73)}


def test_suffix_dedup_is_brute_force(docs, empty):
    for length in (64, 400):
        texts = [raw(t) for _, t, *_ in ROWS]
        count = collections.Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
        want = []
        for (doc, *_), t in zip(ROWS, texts):
            gone = np.zeros(len(t) + 1, bool)
            for k in range(len(t) - length + 1):
                if count[t[k : k + length]] > 1:
                    gone[k : k + length] = True
            spans = int((gone[1:] & ~gone[:-1]).sum() + (len(t) and gone[0]))
            left = bytes(np.frombuffer(t, np.uint8)[~gone[:-1]])
            want.append((doc, len(t), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
        same(suffix_dedup.digest(docs, length), want, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        del count
    assert suffix_dedup.digest(empty).count() == 0


def test_suffix_dedup_gives_the_same_when_parts_are_hot(docs):
    def covered(spans):
        return {(r._row, k) for r in spans.collect() for k in range(r.start, r.end)}

    rows = C.with_row(docs, "text")
    parts = C.partitions(docs.sparkSession) * substring_dedup.BUCKETS_PER_PARTITION * substring_dedup.PARTS
    for length in (64, 400):
        want = covered(suffix_dedup.repeated_spans(rows, length))
        for least, share in ((1, 0), (3, 1)):
            assert len(suffix_dedup.hot_parts(rows, parts, length, least, share))
            assert covered(suffix_dedup.repeated_spans(rows, length, least, share)) == want
    # One header, each time before other bytes; two of the texts share more than it.
    texts = [f"{'header ' * 20}{rng.random()} {prose(120)}" for _ in range(60)]
    texts.append("new " + texts[5])
    docs = docs.sparkSession.createDataFrame(list(enumerate(texts)), "_row long, text string").repartition(5)
    size = len(raw(texts[5]))
    for least, share in ((1, 0), (20, 0), (10**9, 16)):
        got = covered(suffix_dedup.repeated_spans(docs, 400, least, share))
        assert got == {(5, k) for k in range(size)} | {(60, k) for k in range(4, size + 4)}


def test_multikey_sort_orders_and_counts_common_bytes():
    r = np.random.default_rng(0)
    for rows in (0, 1, 2, 50):
        m = r.integers(0, 3, (rows, 21)).astype(np.uint8)
        m[: rows // 2, 6:] = 1
        order, common = suffix_dedup.multikey_sort(m)
        shown = [m[i].tobytes() for i in order]
        assert shown == sorted(shown)
        for i in range(1, rows):
            k = 0
            while k < 21 and shown[i][k] == shown[i - 1][k]:
                k += 1
            assert common[i] == k


def shingles(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def joined(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_minhash_dedup_is_brute_force(docs, empty, monkeypatch):
    sets = [shingles(t) for _, t, *_ in ROWS]
    edges = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    of = joined(len(sets), edges)
    least = {}
    for i, c in enumerate(of):
        ids = [x for x in (least.get(c), ROWS[i][0]) if x is not None]
        least[c] = min(ids) if ids else None
    want = [(r[0], len(s), least[c], r[0] == least[c]) for r, s, c in zip(ROWS, sets, of)]
    same(minhash_dedup.digest(docs), want, "doc_id", "n_shingles", "component_id", "kept")
    kept = minhash_dedup.dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(of))
    assert minhash_dedup.digest(empty).count() == 0 and minhash_dedup.dedup(empty).count() == 0
    monkeypatch.setattr(minhash_dedup, "BLOCK_MEMBERS", 2)  # every group in several blocks
    same(minhash_dedup.digest(docs), want, "doc_id", "n_shingles", "component_id", "kept")


def test_pipeline_removes_near_copies_from_four_fifths(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    sets = [shingles(r.text) for r in rows]
    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    common = collections.Counter((a, b) for ids in holders.values() for k, a in enumerate(ids) for b in ids[:k])

    def kept(percent):
        edges = [(a, b) for (a, b), n in common.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
        least = {}
        for r, c in zip(rows, joined(len(sets), edges)):
            least[c] = min(least.get(c, r.doc_id), r.doc_id)
        return sorted(least.values())

    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf).select("doc_id").collect())
    assert got == kept(80) != kept(85)


def test_super_minhash_estimates_similarity():
    r = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.85):
        agree = []
        for _ in range(40):
            common = r.integers(0, 1 << 63, int(300 * share)).astype(np.uint64)
            x, y = (np.concatenate([common, r.integers(0, 1 << 63, (300 - len(common)) // 2).astype(np.uint64)]) for _ in range(2))
            best = minhash_dedup.super_minhash(np.repeat([0, 1], [len(x), len(y)]), np.concatenate([x, y]), 2)
            agree.append((best[0] == best[1]).mean())
        assert abs(np.mean(agree) - len(common) / (len(x) + len(y) - len(common))) < 0.02


def test_spanning_links_join_what_links_join():
    r = np.random.default_rng(1)
    for trial in range(60):
        base, m = r.integers(0, 1 << 60, r.integers(5, 60)).astype(np.uint64), int(r.integers(2, 30))
        sets = []
        for _ in range(m):
            x = base.copy()
            k = int(r.integers(0, len(x) // 4 + 1))
            x[r.choice(len(x), k, replace=False)] = r.integers(0, 1 << 60, k).astype(np.uint64)
            sets.append(np.unique(x))
        split = 0 if trial % 2 else int(r.integers(1, m))
        links = []
        for a in range(m):
            for b in range(a + 1, m):
                both = len(np.intersect1d(sets[a], sets[b]))
                if (not split or a < split <= b) and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                    links.append((a, b))
        assert joined(m, minhash_dedup.spanning_links(sets, split)) == joined(m, links)


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(500 + i, 501 + i) for i in range(200)] + [(1000, 2000 + i) for i in range(300)] + [(7, 7)]
    got = {x.node: x.component for x in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = joined(3000, edges)
    assert got == {n: want[n] for e in edges if e[0] != e[1] for n in e}
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embedding_dedup_is_brute_force(spark):
    r = np.random.default_rng(2)
    base = r.standard_normal((12, 16))
    vectors = [b + r.standard_normal(16) * s for b in base for s in (0, 0, 0.1, 0.1, 0.2, 0.3)]
    rows = [(i, [float(np.float32(x)) for x in v], i % 3 if i % 11 else None) for i, v in enumerate(vectors)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [float("inf")] * 16, 1), (904, [1.0, None], 1), (905, [], 1), (906, [1.0, 2.0], 1), (907, [2.0, 4.0], 1)]
    rows += [rows[3], (None, rows[3][1], rows[3][2])]
    fit = [lab is not None and bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    edges = []
    for a in range(len(rows)):
        for b in range(a):
            if fit[a] and fit[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.93 - 1e-12:
                    edges.append((a, b))
    of, degree = joined(len(rows), edges), collections.Counter(x for e in edges for x in e)
    least = {c: min(r[0] for r, o in zip(rows, of) if o == c and r[0] is not None) if any(r[0] is not None for r, o in zip(rows, of) if o == c) else None for c in of}
    want = [(row[0], degree[i], least[of[i]], row[0] == least[of[i]]) for i, row in enumerate(rows)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit(1)).withColumn("key", F.lit(2))
    assert len(edges) > 20
    for block in (2048, 3):
        same(embedding_dedup.groups(frame, block=block), want, "vec_id", "n_links", "component_id", "kept")
    assert embedding_dedup.groups(frame.limit(0)).count() == 0


def pieces_hold(pieces, size=1024, end=0):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_path())
    model.encode_special_tokens = True
    whole = collections.Counter(tuple(model.encode(t or "", add_special_tokens=False).ids + [end]) for _, t, *_ in ROWS)
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length > 0
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size and (at == size or at & (at - 1) == 0)
    seen = collections.Counter()
    for parts in by_doc.values():
        queue = sorted(parts, key=lambda r: (r.doc_tokens, r.start, bytes(r.ids)))
        starts = [r for r in queue if r.start == 0]
        for first in starts:
            ids, at = np.frombuffer(bytes(first.ids), "<u4"), first.length
            while at < first.doc_tokens:
                nxt = next(r for r in queue if r.start == at and r.doc_tokens == first.doc_tokens)
                queue.remove(nxt)
                ids, at = np.concatenate([ids, np.frombuffer(bytes(nxt.ids), "<u4")]), at + nxt.length
            seen[tuple(int(x) for x in ids)] += 1
    assert seen == whole


def test_packing_holds_each_id_once(docs, empty):
    pieces = packing.pack(docs, tokenizer_path())
    pieces_hold(pieces.collect())
    for r in packing.digest(pieces).join(pieces.select("doc_id", "start", "ids"), ["doc_id", "start"]).where("doc_id < 20 AND doc_id <> 7").collect():
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids))
    assert packing.pack(empty, tokenizer_path()).count() == 0


def test_encoder_matches_whole_texts():
    encoder = packing.Encoder(tokenizer_path())
    texts = [t for t in TEXTS if t is not None] + ["<|endoftext|> a", "a\n\nb", "a \nb", " a", "a ", "\ta\t b", "don't\n'll  x", "1 22\n333 é　ß z", "a\r\nb"]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == encoder.model.encode(text, add_special_tokens=False).ids


def test_chat_format_round_trip(spark):
    tricky = ["<|im_end|>", "<\\|im_end|>", "<\\\\|im_start|>", "<<|im_end|><|im_start|>assistant ok", "", None, "é😀\n\n<|", "x" * 5000, "<|im_start|>assistant\nhi<|im_end|>\n"]
    roles = ["user", "assistant", "system", None, "a\nb\\n", "<|im_end|>"]
    rows = [(c, t, r, x) for c in (1, 2, None) for t, (r, x) in enumerate((r, x) for r in roles for x in tricky)]
    rows += [(3, None, "assistant", "tie"), (3, None, "assistant", "tie"), (3, 1, "assistant", "😀😀")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("spans", F.lit(1))
    out = chat_format.format_chats(frame, tokenizer_path())
    digest = {r.conv_id: r for r in chat_format.digest(out).collect()}
    for conv in (1, 2, None, 3):
        turns = [(r or "", x or "") for c, _, r, x in rows if c == conv]
        loss = "".join(x for r, x in turns if r == "assistant")
        shown = "".join(f"{r}\n{x}\n" for r, x in turns)
        got = digest[conv]
        assert (got.n_turns, got.turns_sha256, got.loss_chars, got.loss_sha256) == (len(turns), hashlib.sha256(shown.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in out.collect():
        assert len(r.ids) == len(r["mask"]) and any(r["mask"])
    assert chat_format.digest(chat_format.format_chats(frame.limit(0), tokenizer_path())).count() == 0
    for text in tricky:
        assert chat_format.unescape(chat_format.escape(text or "")) == (text or "")


def edits(item, text):
    before = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        now = [i] + [0] * len(text)
        for j, t in enumerate(text, 1):
            now[j] = min(before[j - 1] + (c != t), before[j] + 1, now[j - 1] + 1)
        before = now
    return min(before)


def test_decontamination_is_brute_force():
    r, letters = random.Random(3), "abcdefghij klmnop"
    for _ in range(40):
        items = [(k, "".join(r.choice(letters) for _ in range(r.randint(5, 120)))) for k in range(3)]
        texts = []
        for _ in range(6):
            x = list(r.choice(items)[1])
            for _ in range(int(len(x) * r.choice([0, 0.05, 0.1, 0.15]))):
                p, kind = r.randrange(len(x)), r.random()
                x[p : p + (kind < 0.7)] = [] if 0.4 < kind < 0.7 and len(x) > 1 else [r.choice(letters)]
            texts.append("".join(r.choice(letters) for _ in range(r.choice([0, 3, 40]))) + "".join(x) + "".join(r.choice(letters) for _ in range(r.choice([0, 3, 40]))))
        index, flat = decontamination.Index(items), [decontamination.plain(t.encode()) for t in texts]
        got = {}
        for row, item, a, b, e in decontamination.occurrences(index, np.concatenate(flat), np.concatenate([[0], np.cumsum([len(x) for x in flat])])):
            got[row, item] = min(e, got.get((row, item), 99))
            assert edits(index.texts[item].tolist(), flat[row][a:b].tolist()) <= e
        want = {(i, k): edits(index.texts[k].tolist(), t.tolist()) for i, t in enumerate(flat) for k in range(3)}
        assert got == {key: e for key, e in want.items() if e <= index.edits[key[1]]}


def test_decontamination_of_tables(spark, docs, empty, monkeypatch):
    bench = spark.createDataFrame([(1, PASSAGE), (1, PASSAGE), (2, None), (3, ""), (4, PASSAGE.upper().replace(" ", "\n")), (None, LONG[:300])], "item_id long, text string")
    want = {i for i, (_, t, *_) in enumerate(ROWS) if t and (PASSAGE in t or t == LONG)}
    assert {r.doc_id for r in decontamination.hits(docs, bench).collect()} == {ROWS[i][0] for i in want}
    left = decontamination.remove(docs, bench)
    assert left.columns == docs.columns and left.count() == len(ROWS) - len(want)
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 200)  # several passes
    assert decontamination.remove(docs, bench).count() == len(ROWS) - len(want)
    assert decontamination.hits(empty, bench).count() == 0 and decontamination.remove(docs, bench.limit(0)).count() == len(ROWS)


def test_lm_scores_are_brute_force(docs, empty):
    held_out = crc_is("doc_id", 5, 1)
    found = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split() + [None] for _, t, *_ in ROWS]
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 1 for r in ROWS]
    count = collections.Counter(w for ws, h in zip(found, held) if not h for w in ws)
    total, distinct = sum(count.values()), len(count)
    want = [(r[0], h, len(ws), sum(count[w] > 0 for w in ws), total, round(sum(math.log10((count[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws), 4)) for r, h, ws in zip(ROWS, held, found)]
    out = lm_scoring.score(docs, held_out).withColumn("base", F.round("base_score", 4))
    same(out, want, "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base")
    assert out.where("score > 0 OR score IS NULL").count() == 0
    assert lm_scoring.score(empty, held_out).count() == 0
    untaught = lm_scoring.score(docs, F.lit(True)).collect()
    assert {(r.n_known, r.train_tokens, round(r.base_score, 9)) for r in untaught} == {(0, 0, 0.0)}


def test_lm_filter_knows_all_levels():
    r = np.random.default_rng(4)
    pairs = np.unique(r.integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2))
    level = r.integers(1, 6, len(pairs))
    segments, segment_bits = 256, 1 << 10
    bits = np.zeros(segments * segment_bits // 8, np.uint8)
    for p, n in zip(pairs, level):
        for k in range(1, n + 1):
            for place in lm_scoring._places(np.array([p]), k, segment_bits):
                place = int(place[0]) + int(p >> np.uint64(56)) * segment_bits
                bits[place >> 3] |= 1 << (place & 7)
    got = lm_scoring.probed(bits, segment_bits, 1, pairs)
    assert (got >= level).all() and (got == level).mean() > 0.8
    assert (lm_scoring.probed(bits, segment_bits, 1, r.integers(0, 1 << 63, 3000).astype(np.uint64)) == 0).mean() > 0.8


def test_lm_filter_grows_with_its_entries():
    r = np.random.default_rng(5)
    sizes = []
    for n in (100, 10_000, 300_000):
        pairs, level = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64)), r.integers(1, 6, n)
        bits = lm_scoring.filled(pairs, level)
        assert (lm_scoring.probed(bits, 8 * len(bits), 1, pairs) >= level).all()
        sizes.append(len(bits) / level.sum())
    assert max(sizes) < 1.01 * min(sizes)


def test_lm_filter_finds_few_unknown_pairs_at_any_size():
    r = np.random.default_rng(6)
    for n in (100, 10_000, 300_000):
        bits = lm_scoring.filled(np.unique(r.integers(0, 1 << 63, n).astype(np.uint64)), r.integers(1, 6, n))
        unknown = r.integers(0, 1 << 63, 100_000).astype(np.uint64)
        assert (lm_scoring.probed(bits, 8 * len(bits), 1, unknown) > 0).mean() < 0.0005


def test_lm_levels_are_bounded_by_the_words():
    before, n = np.array([3, 3, 1000, 0, 5]), np.array([1000, 2, 1000, 7, 0])
    assert (lm_scoring.shares(np.full(5, 9), before, n) * before <= np.minimum(before, n)).all()


def test_lm_pairs_seen_once_count(docs):
    held_out = crc_is("doc_id", 5, 1)
    found = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split() + [None] for _, t, *_ in ROWS]
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 1 for r in ROWS]
    count = collections.Counter(w for ws, h in zip(found, held) if not h for w in ws)
    pairs = collections.Counter(p for ws, h in zip(found, held) if not h for p in zip([None] + ws, ws))
    total, distinct = sum(count.values()), len(count)

    def model(before, w):
        n = pairs[before, w]
        share = 2 ** (n.bit_length() - 1) / count[before] if n else 0
        return math.log10(0.2 * share + 0.8 * (count[w] + 0.5) / (total + 0.5 * (distinct + 1)))

    want = [(r[0], sum(model(*p) for p in zip([None] + ws, ws))) for r, ws in zip(ROWS, found)]
    got = [(r.doc_id, r.score) for r in lm_scoring.score(docs, held_out).collect()]
    assert sorted((d is None, d, round(v, 3)) for d, v in got) == sorted((d is None, d, round(v, 3)) for d, v in want)


def test_language_id(docs, empty, spark):
    out = language_id.identify(docs, crc_is("doc_id", 3, 1)).collect()
    assert len(out) == len(ROWS)
    letter = {r[0]: bool(r[1]) and any(c.isalpha() for c in r[1]) for r in ROWS}
    assert all((r.lang_pred == "und") == (not letter[r.doc_id]) and 0 <= r.score <= 1 for r in out)
    assert language_id.identify(empty, crc_is("doc_id", 3, 1)).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs, F.lit(True)).collect()} == {"und"}
    r = random.Random(8)
    tongues = {f"l{k}": ["".join(r.choice("abcdefghijklmnop") for _ in range(3)) for _ in range(8)] for k in range(70)}  # more than a word of bits
    rows = [(k * 70 + i, " ".join(r.choice(syllables) + r.choice(syllables) for _ in range(60)), lang, "", 0) for k in range(6) for i, (lang, syllables) in enumerate(tongues.items())]
    alike = language_id.identify(spark.createDataFrame(rows, SCHEMA), crc_is("doc_id", 3, 1)).where("held_out").collect()
    truth = {x[0]: x[2] for x in rows}
    assert np.mean([truth[x.doc_id] == x.lang_pred for x in alike]) >= 0.8


def test_grammar_says_what_a_clause_says():
    insults = np.array([toxicity.beginning(np.array([int.from_bytes(w[:8].ljust(8, b"\0"), "big")], np.uint64), 5)[0] for w in (b"idiot", b"moron")])
    insults.sort()

    def kinds(text):
        data, at = C.text_buffer(__import__("pyarrow").array([text]))
        counts = toxicity.clause_counts(data, at, insults)[0]
        return {k for k, n in zip(toxicity.KINDS, counts) if n}

    assert kinds("What an idiot. Fine day.") == {"insult"}
    assert kinds("You are a moronic thing") == {"aimed insult"}
    assert kinds("He is not an idiot") == {"negated"}
    assert kinds("He is not here, idiot") == {"insult"}
    assert kinds("She said that was idiot talk") == {"reported"}
    assert kinds("I will kill time. They kill") == {"threat", "aimed threat"}
    assert kinds("idio tic. mor, on") == set()


def test_toxicity(spark, docs, empty):
    r = random.Random(9)
    bad = [f"{prose(30)}. you {r.choice(['zorgling', 'kwaxter'])} {prose(5)}. {prose(20)}" for _ in range(80)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(bad + [prose(60) for _ in range(240)])] + [(None, bad[0], None, None, None), (999, None, "en", "s", 0), (998, "", "en", "s", 0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, 0, int(i < 80)) for i in range(320)] + [(None, 0, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    out = toxicity.score(frame, labels, ~crc_is("doc_id", 5, 0)).collect()
    assert len(out) == len(rows) and all(0 <= x.score <= 1 for x in out)
    assert np.mean([(x.score >= 0.5) == (x.doc_id < 80) for x in out if x.doc_id is not None and x.doc_id < 320]) > 0.98
    left = toxicity.remove(frame, labels, ~crc_is("doc_id", 5, 0))
    assert left.columns == frame.columns and 236 <= left.count() <= 246
    assert toxicity.score(empty, labels, F.lit(True)).count() == 0
    assert {x.score for x in toxicity.score(docs, labels.limit(0), F.lit(True)).collect()} == {0.0}
