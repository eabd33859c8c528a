"""Inverted index of texts: posting lists with positions, kept as a table.

A posting says which document holds a term, and where. Documents are dealt by the hash of
their key into blocks of about ``BLOCK_DOCS``, so the list of a term that all texts hold comes
in as many pieces as there are blocks, and a term's pieces meet those of other terms by block
number. Texts travel to the task of their block whole; postings arise there and travel once
more, as two arrays a list (documents, places), to the folder of their term. The table is laid out in folders by the hash of the term and sorted by term inside: a
search reads the folders of its terms only and, inside them, the row groups that may hold the
terms. Blocks in which a term is missing are skipped before their lists are opened.

Each call of ``add`` writes a generation of its own and leaves what is there as it is. Rows that
share a key within a generation are one document, whose places overlap; a key that comes again
in a later one is another document. A null text holds no terms. Terms are runs of a-z in lower case.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FOLDERS, BLOCK_DOCS, FILES, MOST_TASKS = 64, 1024, 16, 4096


def terms_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z]+"), lambda t: t != "")


def folder(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(FOLDERS)).cast("int")


@dataclass(frozen=True)
class TextIndex:
    """An index below ``path``: posting lists by folder."""

    spark: SparkSession
    path: str
    key: str

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def add(self, docs: DataFrame, text: str, generation: int) -> TextIndex:
        """Index more documents under a new generation."""
        blocks = max(1, -(-docs.count() // BLOCK_DOCS))
        block = F.pmod(F.xxhash64(self.key), F.lit(blocks)).cast("int").alias("block")
        dealt = docs.select(block, F.col(self.key).alias("doc"), F.col(text).alias("text")).repartition(min(blocks, MOST_TASKS), "block")
        found = dealt.select("block", "doc", F.posexplode(terms_of(F.col("text"))).alias("place", "term"))
        lists = found.groupBy("block", "term").agg(F.sort_array(F.collect_list(F.struct("doc", "place"))).alias("list"))
        laid = lists.select(
            F.lit(generation).alias("generation"), "block", "term", F.col("list.doc").alias("docs"), F.col("list.place").alias("places"), folder(F.col("term")).alias("folder")
        )
        laid.repartition(min(blocks, FOLDERS * FILES), "folder", F.col("block") % FILES).sortWithinPartitions("folder", "term", "block").write.partitionBy("folder").mode("append").parquet(self.path)
        return self

    def lists(self, terms: list[str]) -> DataFrame:
        """Lists of the blocks that hold all of the different ``terms``; other folders aren't read."""
        folders = [r.f for r in self.spark.createDataFrame([(t,) for t in terms], "t string").select(folder(F.col("t")).alias("f")).distinct().collect()]
        rows = self.postings.where(F.col("folder").isin(folders) & F.col("term").isin(terms))
        in_block = F.count("*").over(Window.partitionBy("generation", "block"))
        return rows.withColumn("_terms", in_block).where(F.col("_terms") == len(terms)).drop("_terms")

    def match_all(self, terms: list[str]) -> DataFrame:
        """(key, hits): documents that hold every term, with the number of occurrences."""
        wanted = sorted(set(terms))
        places = self.lists(wanted).select("generation", "block", _bits(wanted).alias("_bit"), F.explode(F.arrays_zip(F.col("docs").alias("doc"), F.col("places").alias("place"))).alias("p"))
        hits = places.groupBy("generation", "block", F.col("p.doc").alias(self.key)).agg(F.count("*").alias("hits"), F.bit_or("_bit").alias("_all"))
        return hits.where(F.col("_all") == (1 << len(wanted)) - 1).select(self.key, "hits")

    def match_phrase(self, terms: list[str]) -> DataFrame:
        """(key, hits): documents that hold the terms one after the other, with the number of places where they do."""
        steps = F.filter(F.array(*[F.when(F.col("term") == t, F.lit(k)) for k, t in enumerate(terms)]), lambda s: s.isNotNull())
        begins = self.lists(sorted(set(terms))).withColumn("_step", F.explode(steps))
        places = begins.select("generation", "block", "_step", F.explode(F.arrays_zip(F.col("docs").alias("doc"), F.col("places").alias("place"))).alias("p"))
        starts = places.groupBy("generation", "block", F.col("p.doc").alias(self.key), (F.col("p.place") - F.col("_step")).alias("_start")).agg(
            F.bit_or(F.expr("shiftleft(1L, _step)")).alias("_all")
        )
        hits = starts.where(F.col("_all") == (1 << len(terms)) - 1).groupBy("generation", "block", self.key).agg(F.count("*").alias("hits"))
        return hits.select(self.key, "hits")


def _bits(terms: list[str]) -> Column:
    """A bit for each term."""
    first = F.when(F.col("term") == terms[0], F.lit(1))
    return reduce(lambda c, i: c.when(F.col("term") == terms[i], F.lit(1 << i)), range(1, len(terms)), first)


def build(docs: DataFrame, key: str, text: str, path: str) -> TextIndex:
    return TextIndex(docs.sparkSession, path, key).add(docs, text, 0)
