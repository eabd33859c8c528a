"""Fill-in-middle, line dedup and token alignment against brute force, on tables with every awkward row."""

import collections
import hashlib
import random
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import check
from seamline.llm import fill_in_middle, line_dedup, token_alignment
from seamline.llm.queries import ORACLES, QUERIES, tokenizer_path
from seamline.llm.tokens import ByteBPE

SCHEMA = "doc_id long, text string"
CLASHES = ["_id", "_row", "n", "keep", "h", "slice", "a.b", "output", "form"]


def with_clashes(docs):
    return docs.withColumns({c: F.lit(k) for k, c in enumerate(CLASHES)})


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def counted(df):
    return collections.Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    con = check.duck("/root/testdata/sf0.01")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, "/root/testdata/sf0.01")
    assert want.columns == got.columns
    assert counted(got) == collections.Counter(want.fetchall())
    con.close()


# --- fill-in-middle -----------------------------------------------------------------

rng = random.Random(3)
AWKWARD = [
    None, "", "\n", "a", "a\n", "\n\n", "é\nü\n", "<P", "x<P>", "<\nP>", "a<S>\nb", "<M>", "a<", "a\n<", "<P\n<P", "c<P\n", "ab<S",
    *["".join(rng.choice("aé\n<PS M>€\U0001f600") for _ in range(rng.randint(0, 40))) for _ in range(300)],
    "line\n" * 200_000 + "é", "x" * 3_000_000,
]


def filled(doc, text, cut=100, first=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    digest = sha(f"7:{'' if doc is None else doc}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= cut:
        return doc, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < first:
        return doc, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_is_brute_force(spark):
    rows = [*enumerate(AWKWARD), (None, "a\nb"), (5, "a\nb"), (5, "a\nb")]
    docs = with_clashes(spark.createDataFrame(rows, SCHEMA).repartition(3))
    want = [filled(*r) for r in rows]
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    got = counted(fill_in_middle.digest(docs))
    assert got == collections.Counter((*w[:5], sha(w[5]), sha(t or "")) for w, (_, t) in zip(want, rows))
    some = [r for r in rows if len(r[1] or "") < 1000]
    got = counted(fill_in_middle.transform(spark.createDataFrame(some, SCHEMA), cut_share=60, suffix_first=10))
    assert got == collections.Counter(filled(*r, 60, 10) for r in some)
    assert fill_in_middle.digest(docs.limit(0)).count() == 0


def test_outputs_are_rebuilt_from_themselves_alone(spark):
    docs = spark.createDataFrame(list(enumerate(AWKWARD[:300])), SCHEMA)
    outputs = fill_in_middle.transform(docs).select("doc_id", "form", "output")
    alone = spark.createDataFrame(outputs.collect(), outputs.schema)
    assert counted(fill_in_middle.restored(alone).select("doc_id", "restored")) == collections.Counter((i, t or "") for i, t in enumerate(AWKWARD[:300]))


# --- line dedup ---------------------------------------------------------------------

BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def deduped(scan, least=3):
    """Of rows (id, place in the scan, text): id, lines, dropped lines and what stays."""
    order = lambda doc, row: (doc is not None, doc or 0, row)
    key = lambda line: line.strip(BLANKS).translate(LOWER)
    held = collections.defaultdict(set)
    for doc, row, text in scan:
        for line in (text or "").split("\n"):
            held[key(line)].add(order(doc, row))
    for doc, row, text in scan:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 20 or len(held[key(x)]) < least or max(held[key(x)]) == order(doc, row)]
        yield doc, len(lines), len(lines) - len(kept), "\n".join(kept)


@pytest.fixture(scope="module")
def shared(spark):
    r = random.Random(2)
    base = [f"The same Line that many documents hold {i}" for i in range(6)] + ["  \t  ", "short", "", "x" * 19, "Y" * 20, "\x0b" + "Y" * 20 + "\r", "\u00a0" + "Y" * 20]
    base += ["ÄÖÜ äöü ABC long enough line é", "äÖÜ äöü ABC long enough line é", "ÄÖÜ äöü abc long enough line é"]
    texts = ["\n".join(r.choice(base) + r.choice(["", "", " ", "\t"]) if r.random() < 0.8 else str(r.random()) * 2 for _ in range(r.randint(0, 30))) for _ in range(6)]
    rows = [(r.choice([None, *range(60)]), r.choice([None, "", *texts])) for _ in range(80)]
    rows += [(100 + i, "a very common line of very many documents\n" * 50 + f"and one of its own, {i}") for i in range(300)]
    return with_clashes(spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id")).withColumn("n_chars", F.length("text").cast("int"))


def test_line_dedup_is_brute_force_however_ranges_fall(spark, shared):
    scan = [tuple(r) for r in shared.select("doc_id", F.monotonically_increasing_id(), "text").collect()]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "3", "8", "40"):  # with 40 ranges, one hot line fills many of them
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert counted(line_dedup.digest(shared)) == collections.Counter((*w[:3], sha(w[3])) for w in deduped(scan)), n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert line_dedup.digest(shared.limit(0)).count() == 0


def test_trimmed_documents_and_their_bitmaps(spark, shared):
    kept = line_dedup.trimmed(shared)
    assert kept.columns == shared.columns
    scan = [tuple(r) for r in shared.select("doc_id", F.monotonically_increasing_id(), "text").collect()]
    want = collections.Counter((w[0], None if t is None else w[3]) for w, (*_, t) in zip(deduped(scan), scan))
    assert counted(kept.select("doc_id", "text")) == want
    assert kept.where("n_chars <> length(text)").count() == 0
    docs = spark.createDataFrame([(i, "one own line\n" + "\n".join(["a line that four documents hold"] * 3)) for i in range(4)], "_id long, text string")
    found = line_dedup.bitmaps(docs.withColumn("_row", F.col("_id"))).orderBy("_row").collect()
    assert [(r._row, r.n_dropped, [tuple(k) for k in r.keep]) for r in found] == [(i, 3, [(0, 1), (4, None)]) for i in range(3)]


def test_line_dedup_stays_native_and_sends_no_text_with_lines(spark, sf):
    plan = QUERIES["op12_line_dedup"](spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan


# --- token alignment ----------------------------------------------------------------

A, B = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")


def both_tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def aligned(rows):
    """Brute force: every end of A is looked for among the ends of B."""
    a_model, b_model = both_tokenizers()
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
    ends = lambda parts: [sum(map(len, parts[: k + 1])) for k in range(len(parts))]
    done, count = [], collections.Counter()
    for doc, text in rows:
        whole = f" {text or ''}".encode()
        a = a_model.encode(whole.decode(), add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        a_bytes = [bytes(byte[c] for c in a_model.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            done.append((doc, [], [], [], ""))
            continue
        a_ends, b_ends = ends(a_bytes), ends(b_bytes)
        links = [(i, b[b_ends.index(e)]) for i, e in zip(a, a_ends) if e in b_ends]
        groups, at = [], (0, 0)
        for e in [e for e in a_ends if e in b_ends]:
            to = a_ends.index(e) + 1, b_ends.index(e) + 1
            groups.append(",".join(map(str, a[at[0] : to[0]])) + "|" + ",".join(map(str, b[at[1] : to[1]])))
            at = to
        count.update(links)
        done.append((doc, a, b, links, sha(";".join(groups))))
    best = collections.defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [(d, len(a), len(b), len(ln), len(ln), sum(count[x] == best[x[1]] for x in ln), sum(count[x] for x in ln), g) for d, a, b, ln, g in done]


def test_token_alignment_is_brute_force(spark, sf):
    texts = [r.text[:3000] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()]
    texts += [None, "", " ", "\n", "  a  b ", "a▁b", "<s><|endoftext|></s><0x41><unk>", "\x00", "ｆｕｌｌ\U0001f600é", "é", "x" * 3000, texts[0], " " * 100]
    rows = [*enumerate(texts), (None, texts[3]), (4, texts[4])]
    docs = with_clashes(spark.createDataFrame(rows, SCHEMA).repartition(3))
    want = collections.Counter(aligned(rows))
    assert sum(w[1] == 0 for w in want) == 3  # null, empty, U+2581
    for links in (token_alignment.LINKS, 300, 1):
        assert counted(token_alignment.digest(docs, A, B, links)) == want, links
    assert token_alignment.digest(docs.limit(0), A, B).count() == 0


def test_slices_are_bounded_however_much_a_task_reads(spark):
    empty = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text")).coalesce(1)
    parts = token_alignment.slices(empty, A, B)  # texts without links end a slice, too
    assert parts.agg(F.sum(F.size("docs")), F.max(F.size("docs")) <= 20_000).first() == (40_000, True)
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 8)))
    docs = spark.createDataFrame([(i, " ".join(word() for _ in range(2000))) for i in range(400)], SCHEMA).coalesce(1)
    parts = token_alignment.slices(docs, A, B, links=40_000)
    assert parts.agg(F.sum(F.size("docs"))).first()[0] == 400
    assert parts.where(F.octet_length("which") > 3 * F.expr("aggregate(docs, 0L, (s, d) -> s + d.n_links)")).count() == 0  # packed
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in parts.inputFiles()]
    groups = [m.row_group(k) for m in files for k in range(m.num_row_groups)]
    assert len(groups) > 1 and max(g.total_byte_size for g in groups) <= token_alignment.ROW_GROUP
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"


def test_sums_meet_a_slice_in_sorted_rows(spark, sf):
    plan = QUERIES["op13_token_alignment"](spark, sf)._jdf.queryExecution().toString()
    assert "CoGroups" in plan and "collect_list" not in plan and "ObjectHashAggregate" not in plan


def test_groups_cover_the_same_bytes(spark):
    text = "Aligned tokens of naïve \U0001f600 texts,\n\n  twice."
    row = token_alignment.align(spark.createDataFrame([(1, text)], SCHEMA), A, B).first()
    assert sum(row.a_sizes) == len(row.a_ids) and sum(row.b_sizes) == len(row.b_ids) and len(row.a_sizes) == len(row.b_sizes)
    one = token_alignment.Aligner(A, B)
    a_at = b_at = 0
    for m, n in zip(row.a_sizes, row.b_sizes):
        assert b"".join(one.a.bytes[i] for i in row.a_ids[a_at : a_at + m]) == b"".join(one.b.bytes[i] for i in row.b_ids[b_at : b_at + n])
        a_at, b_at = a_at + m, b_at + n


def test_both_libraries_give_the_same_ids():
    a, _ = both_tokenizers()
    own = ByteBPE(A)
    points = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    r = random.Random(1)
    texts = ["".join(points[i : i + 40]) for i in range(0, len(points), 40)]
    texts += ["".join(r.choice(points[:0x250]) if r.random() < 0.6 else r.choice(" aB1.\n'") for _ in range(40)) for _ in range(5000)]
    texts += [f"a{c}a1{c} {c}" for c in points[:0x3000]] + ["<|endoftext|> x<|endoftext|>", "a" * 50_000]
    assert [e.ids for e in a.encode_batch(texts, add_special_tokens=False)] == [own.encode(t) for t in texts]
