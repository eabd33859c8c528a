"""Queries that apply each operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.llm import (
    chat_format, decontamination, embedding_dedup, fill_in_middle, language_id, line_dedup, lm_scoring, minhash_dedup, packing,
    substring_dedup, suffix_dedup, token_alignment, toxicity,
)
from seamline.llm import common as C


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file, the same on all machines."""
    import public_tokenizers

    return public_tokenizers.path(name)


def crc_is(column: str, n: int, value: int) -> Column:
    """crc32 of the id as text leaves ``value``; false where the id is null."""
    return F.coalesce(C.crc_mod(column, n) == value, F.lit(False))


def op1_suffix_array_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.digest(C.table(spark, sf, "documents"))


def op2_embedding_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return embedding_dedup.groups(C.table(spark, sf, "embeddings"))


def op3_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    held_out = crc_is("doc_id", 5, 0)
    scored = toxicity.score(C.table(spark, sf, "documents"), C.table(spark, sf, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *toxicity.NAMES)


def op4_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return language_id.identify(C.table(spark, sf, "documents"), crc_is("doc_id", 3, 1)).drop("_row")


def op5_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substring_dedup.digest(C.table(spark, sf, "documents"))


def op6_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    return lm_scoring.score(C.table(spark, sf, "documents"), crc_is("doc_id", 5, 1)).drop("_row")


def op7_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return minhash_dedup.digest(C.table(spark, sf, "documents"), percent=85)


def op8_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.digest(packing.pack(C.table(spark, sf, "documents"), tokenizer_path()))


def op9_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    turns = C.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    return chat_format.digest(chat_format.format_chats(turns.unionByName(extra), tokenizer_path()))


def op10_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontamination.hits(C.table(spark, sf, "documents"), C.table(spark, sf, "benchmark")).drop("_row")


def op11_fill_in_middle(spark: SparkSession, sf: str) -> DataFrame:
    return fill_in_middle.digest(C.table(spark, sf, "documents"))


def op12_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return line_dedup.digest(C.table(spark, sf, "documents"))


def op13_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return token_alignment.digest(C.table(spark, sf, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_suffix_array_dedup, op2_embedding_near_dedup, op3_toxicity, op4_language_id, op5_substring_dedup,
        op6_lm_scoring, op7_minhash_near_dedup, op8_packing, op9_chat_formatting, op10_benchmark_decontamination,
        op11_fill_in_middle, op12_line_dedup, op13_token_alignment,
    )
}
ORACLES: dict[str, str] = {
    "op11_fill_in_middle": r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
           regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u
    FROM documents),
drawn AS (
    SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS c2,
           CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 100 THEN 'plain'
                WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM d),
parts AS (
    SELECT doc_id, t, n, form, array_to_string(u[1:least(c1, c2)], '') AS p, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m,
           array_to_string(u[greatest(c1, c2) + 1:], '') AS s
    FROM drawn),
made AS (
    SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS o
    FROM parts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(o) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN o
                   WHEN 'psm' THEN split_part(split_part(o, '<P>', 2), '<S>', 1) || split_part(o, '<M>', 2) || split_part(split_part(o, '<S>', 2), '<M>', 1)
                   ELSE split_part(split_part(o, '<P>', 2), '<M>', 1) || split_part(o, '<M>', 2) || split_part(split_part(o, '<S>', 2), '<P>', 1) END) AS restored_sha256
FROM made
""",
    "op12_line_dedup": r"""
WITH l AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
many AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, pos, line, last IS NOT NULL AND last <> k.doc_id AS gone FROM k LEFT JOIN many USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""",
}
