"""Line dedup: lines that many documents share stay in the last of them only.

A line's key is the line without white space at its ends, A-Z in lower case. A key of
at least ``LEAST_CHARS`` code points found in at least ``LEAST_DOCS`` documents loses
all its lines except in the document that comes last in the order of ids.

Built from DataFrame functions alone. Hashes of keys (half of a SHA-256, so nobody
makes two keys meet) are range-partitioned on hash, document and position, with the
last document first. A hot line's rows are thus spread over as many segments as they
fill. Inside a segment one pass streams over the sorted rows: the first document of a
hash keeps its lines, a running number of its documents says when there are enough.
A hash in the middle of a segment is whole there. At most the first and the last hash
of a segment may go on elsewhere; their rows are set apart and settled by an aggregate
that combines before its shuffle, whose result has no more rows than twice the
segments and is broadcast. Texts never travel with the lines: what comes back is one
run-compressed bitmap a document, which ``trimmed`` and ``digest`` apply to the text.

Defined cases: a null or empty text is one empty line. A document is a row, so rows
that repeat, or share an id, are several documents, of which the one that the scan
reads last comes last; null ids come before all others. Other columns are carried and
never read. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamline.llm import common as C
from seamline.session import scratch

LEAST_CHARS, LEAST_DOCS = 20, 3
#: White space that is stripped, and the letters that are lower-cased.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: str) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case; ``lower`` does the same, and faster, where all is ASCII."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def keyed(rows: DataFrame, least_chars: int) -> DataFrame:
    """(h, _id, _row, pos) of the lines of rows (_id, _row, text) whose key is long enough."""
    key = F.btrim("line", F.lit(BLANKS))
    lines = rows.select("_id", "_row", F.posexplode(lines_of("text")).alias("pos", "line"))
    long_enough = lines.where(F.length("line") >= least_chars).where(F.length(key) >= least_chars)
    half = F.substring(F.sha2(lower_ascii(key).cast("binary"), 256), 1, 32)
    return long_enough.select(F.unhex(half).alias("h"), "_id", "_row", "pos")


def dropped(rows: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(_row, pos) of the lines that go, of rows (_id, _row, text)."""
    spark = rows.sparkSession
    n = C.partitions(spark)
    last_first = [F.col("_id").desc_nulls_last(), F.col("_row").desc()]
    ranged = keyed(rows, least_chars).repartitionByRange(n, "h", *last_first, "pos")
    segments = ranged.withColumn("seg", F.spark_partition_id())
    whole, per_key = Window.partitionBy("seg"), Window.partitionBy("seg", "h")
    streamed = (
        segments.withColumn("nth", F.dense_rank().over(per_key.orderBy(*last_first)))
        .withColumn("docs", F.max("nth").over(per_key))
        .withColumn("edge", (F.col("h") == F.min("h").over(whole)) | (F.col("h") == F.max("h").over(whole)))
    )
    path = scratch(spark, "lines")
    settled = streamed.where(F.col("edge") | ((F.col("docs") >= least_docs) & (F.col("nth") > 1)))
    settled.select("h", "_id", "_row", "pos", "edge").write.parquet(path)
    found = spark.read.schema(settled.select("h", "_id", "_row", "pos", "edge").schema).parquet(path)

    edges = found.where("edge")
    holders = edges.groupBy("h", "_id", "_row").agg(F.count("*").alias("lines"))
    spread = holders.groupBy("h").agg(F.count("*").alias("docs"), F.max(F.struct("_id", "_row")).alias("last"))
    many = spread.where(F.col("docs") >= least_docs)  # at most two hashes a segment
    beyond = edges.join(F.broadcast(many), "h").where(F.struct("_id", "_row") != F.col("last"))
    return found.where(~F.col("edge")).select("_row", "pos").union(beyond.select("_row", "pos"))


def kept_runs(gone: Column) -> Column:
    """Kept runs [start, end) around sorted places that go; the last run has no end and may be empty."""
    starts = F.filter(gone, lambda x, i: (i == 0) | (F.get(gone, i - 1) < x - 1))
    ends = F.filter(gone, lambda x, i: (i == F.size(gone) - 1) | (F.get(gone, i + 1) > x + 1))
    runs = F.arrays_zip(
        F.concat(F.array(F.lit(0)), F.transform(ends, lambda x: x + 1)).alias("start"),
        F.concat(starts, F.array(F.lit(None).cast("int"))).alias("end"),
    )
    return F.filter(runs, lambda r: r["end"].isNull() | (r["start"] < r["end"]))


def bitmaps(rows: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(_row, n_dropped, keep) of rows (_id, _row, text) that lose a line.

    ``keep`` is the document's keep bitmap as its runs of ones: array of (start, end)
    in lines. A document that isn't listed keeps all its lines.
    """
    gone = dropped(rows, least_chars, least_docs).groupBy("_row").agg(F.sort_array(F.collect_list("pos")).alias("gone"))
    return gone.select("_row", F.size("gone").alias("n_dropped"), kept_runs(F.col("gone")).alias("keep"))


def kept_text(lines: Column, keep: Column) -> Column:
    """The lines of the runs of ``keep``, joined by line feeds."""
    return F.array_join(F.flatten(F.transform(keep, lambda r: F.slice(lines, r["start"] + 1, F.coalesce(r["end"], F.size(lines)) - r["start"]))), "\n")


def applied(rows: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``rows`` (_id, _row, text, ...) with n_lines, n_dropped and the text kept; texts stream past a hash table of bitmaps."""
    found = bitmaps(rows.select("_id", "_row", "text"), least_chars, least_docs)
    joined = rows.join(found.hint("shuffle_hash"), "_row", "left")
    text = F.coalesce("text", F.lit(""))
    split = joined.withColumn("_lines", F.when(F.col("keep").isNotNull(), lines_of("text")))
    return split.select(
        *rows.columns,
        (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"),
        F.when(F.col("keep").isNull(), F.col("text")).otherwise(kept_text(F.col("_lines"), F.col("keep"))).alias("kept"),
    )


def trimmed(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` with the lines kept; ``n_chars``, where there is one, follows a changed text."""
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), C.quoted(key).alias("_id"), "text", C.as_struct(docs.columns).alias("_rest"))
    own = {c: F.col("_rest").getField(c) for c in docs.columns} | {"text": F.col("kept")}
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(own["n_chars"])
    return applied(rows).select(*[own[c].alias(c) for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the hash of the kept text of each row of ``docs``."""
    done = applied(docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").alias("_id"), "text"))
    kept = F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256)
    return done.select(F.col("_id").alias("doc_id"), F.col("n_lines").cast("long"), F.col("n_dropped").cast("long"), kept.alias("kept_sha256"))
