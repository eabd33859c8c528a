"""Documents: chunking, chunk tables, similarity search and answer context."""

from __future__ import annotations

from pyspark.ml.feature import BucketedRandomProjectionLSH, HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline import fixed
from seamline.functions import nested as nx
from seamline.functions import text as tx


def zip_positions(df: DataFrame, left: str, right: str) -> DataFrame:
    """Items of two array columns side by side, up to the shorter one."""
    n = F.least(F.size(left), F.size(right))
    pairs = F.arrays_zip(F.slice(left, F.lit(1), n).alias(left), F.slice(right, F.lit(1), n).alias(right))
    rest = [c for c in df.columns if c not in (left, right)]
    return df.select(*rest, F.posexplode(pairs).alias("position", "_pair")).select(*rest, "position", "_pair.*")


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{fixed.BLANK}+"), lambda x: x != "")


def word_chunks(text: Column, size: int = 512, overlap: int = 50) -> Column:
    """Array of overlapping chunks of ``size`` words."""
    def cut(w: Column) -> Column:
        starts = F.when(F.size(w) > 0, F.sequence(F.lit(1), F.size(w), F.lit(size - overlap))).otherwise(
            F.array().cast("array<int>")
        )
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i, F.lit(size)), " "))

    return tx.bind(words(text), cut)


def chunk_table(docs: DataFrame, path: Column, text: str, title: Column, size: int = 512, overlap: int = 50) -> DataFrame:
    """One row per chunk: ids, content, its markdown twin, position, size, provenance.

    Text and markdown are chunked separately and paired by position up to the
    shorter list. A document without words gives no rows.
    """
    prepared = docs.select(
        nx.path_uuid(path).alias("document_id"), path.alias("file_path"), tx.clean_lines(F.col(text)).alias("_clean"), title.alias("_title")
    )
    marked = prepared.withColumn("_markdown", tx.markdown(F.col("_clean"), F.col("_title"), F.col("file_path"), F.lit(0)))
    chunked = marked.select(
        "document_id", "file_path",
        word_chunks(F.col("_clean"), size, overlap).alias("content"),
        word_chunks(F.col("_markdown"), size, overlap).alias("markdown"),
    )
    paired = zip_positions(chunked.withColumn("total_chunks", F.least(F.size("content"), F.size("markdown"))), "content", "markdown")
    chunk_size = F.length("content")
    metadata = nx.canonical_json({
        "chunk_index": F.col("position").cast("string"), "chunk_size": chunk_size.cast("string"),
        "file_path": F.col("file_path"), "total_chunks": F.col("total_chunks").cast("string"),
    })
    return paired.select(
        nx.chunk_id(F.col("document_id"), F.col("position")).alias("chunk_id"), "document_id", "content", "markdown",
        F.col("position").alias("chunk_index"), "total_chunks", chunk_size.alias("chunk_size"),
        nx.chunk_hash(F.col("content"), metadata).alias("provenance_hash"),
    )


def embed(df: DataFrame, text: str, dimensions: int = 384) -> DataFrame:
    """Hashed term-frequency vector of unit length per text."""
    tokenised = df.withColumn("_tokens", words(F.lower(text)))
    counted = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dimensions).transform(tokenised)
    unit = Normalizer(inputCol="_tf", outputCol="embedding", p=2.0).transform(counted)
    return unit.drop("_tokens", "_tf").withColumn("embedding", vector_to_array("embedding"))


def searchable(docs: DataFrame, vectors_: DataFrame, labels: DataFrame, flags: Column, quality: float = 0.7, contains: str | None = None) -> DataFrame:
    """Documents that may be retrieved: good enough, embedded, relevant, matching."""
    rows = docs.join(labels, "doc_id").join(vectors_, "doc_id").where(F.col("quality") >= quality).where(flags)
    rows = rows.where(F.col("embedding").isNotNull())
    if contains:
        rows = rows.where(F.col("text").ilike(f"%{contains}%") | F.col("source").ilike(f"%{contains}%"))
    return rows


def approximate_nearest(df: DataFrame, vector: str, query: list[float], k: int, bucket_length: float = 0.5, tables: int = 3) -> DataFrame:
    """k near rows found through random-projection hash buckets."""
    prepared = df.withColumn("_vector", array_to_vector(F.col(vector)))
    lsh = BucketedRandomProjectionLSH(
        inputCol="_vector", outputCol="_hashes", bucketLength=bucket_length, numHashTables=tables, seed=42
    )
    model = lsh.fit(prepared)
    found = model.approxNearestNeighbors(prepared, Vectors.dense(query), k, distCol="distance")
    return found.drop("_vector", "_hashes")


def full_text(df: DataFrame, text: str, terms: list[str]) -> DataFrame:
    """Rows holding every term, with the number of occurrences; a scan, no shuffle."""
    tokens = F.filter(F.split(F.lower(text), "[^a-z]+"), lambda t: t != "")
    hits = F.filter(tokens, lambda t: t.isin(terms))
    found = df.withColumn("_hits", hits)
    return found.where(F.size(F.array_distinct("_hits")) == len(set(terms))).withColumn("hits", F.size("_hits")).drop("_hits")


def answer_context(question: str, chunks: DataFrame, weights: DataFrame, changes: DataFrame) -> DataFrame:
    """Prompt context: five chunks, ten weights, five changes.

    Every input is a top-k result, so the lists collected here are short.
    """
    def lines(df: DataFrame, order: Column, text: Column) -> Column:
        return df.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x["t"]), "\n")).scalar()

    number = lambda pattern, c, d: F.format_string(pattern, F.round(c, d))
    c = F.col
    chunk_line = F.concat(
        F.lit("Document "), c("rank").cast("string"), F.lit(": "), c("source"), F.lit(" ("), c("lang"), F.lit(")\nSimilarity: "),
        number("%.3f", c("similarity"), 3), F.lit("\nContent: "), F.substring("text", 1, 500), F.lit("...\n"),
    )
    weight_line = F.concat(F.lit("- "), c("metric"), F.lit(": "), number("%.3f", c("weight"), 3))
    change_line = F.concat(
        F.lit("- "), c("mine_id").cast("string"), F.lit(": "), number("%.3f", c("score"), 3), F.lit(" ("), c("direction"), F.lit(": "),
        number("%+.4f", c("delta"), 4), F.lit(") on "), F.date_format("feature_date", "yyyy-MM-dd"),
    )
    one = chunks.sparkSession.range(1)
    return one.select(F.concat_ws(
        "\n", F.lit(f"User Query: {question}"), F.lit("=== RELEVANT DOCUMENTS ==="), lines(chunks, c("rank"), chunk_line),
        F.lit("=== CURRENT METRIC WEIGHTS ==="), lines(weights, c("rank"), weight_line),
        F.lit("=== RECENT CHANGES ==="), lines(changes, c("rank"), change_line),
    ).alias("context"))


@F.udtf(returnType="position bigint, chunk string")
class WordChunker:
    """Table-valued chunker for lateral joins; ``word_chunks`` is the native form."""

    def eval(self, text: str, size: int, overlap: int):
        tokens = (text or "").split()
        for index, start in enumerate(range(0, len(tokens), size - overlap)):
            yield index, " ".join(tokens[start:start + size])
