"""Sessions of messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamline.functions import numeric
from seamline.functions import text as tx
from seamline.operators.segments import range_segments, with_starts

PAGE_TURNS = 1000


def ordered(messages: DataFrame) -> DataFrame:
    """Ordinal of each message in its session.

    Sessions are cut into range segments, so a session holding a third of all
    messages is numbered by many tasks.
    """
    seg = range_segments(messages, ["conv_id", "created_at", "turn"])
    inside = Window.partitionBy("conv_id", "_seg").orderBy("_pos")
    ordinal = F.col("_start") + F.row_number().over(inside)
    return with_starts(seg, F.lit(1), ["conv_id"]).withColumn("ordinal", ordinal).drop("_seg", "_pos", "_start", "_size")


def nested(messages: DataFrame, page_turns: int = PAGE_TURNS) -> DataFrame:
    """Session pages with their messages nested in order.

    A page holds a fixed number of turns, which bounds the array in a row; a
    session of any length is the sequence of its pages.
    """
    item = F.struct("turn", "role", "text")
    return messages.groupBy("conv_id", F.floor(F.col("turn") / page_turns).alias("page")).agg(
        F.array_sort(F.collect_list(item)).alias("messages")
    )


def ranked(top: DataFrame, order: list[Column]) -> DataFrame:
    """Position 1, 2, … of the rows of a short top-k result."""
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def audited(answers: DataFrame, text: str, mean_similarity: Column) -> DataFrame:
    """Citations, length, verdict and confidence of logged answers."""
    citations, length = tx.citation_count(F.col(text)), F.length(text)
    return answers.withColumns({
        "citations": citations, "characters": length, "valid": citations >= 2,
        "confidence": numeric.response_confidence(citations, mean_similarity, length),
        "reason": F.when(citations >= 2, "Passed validation").otherwise("Failed validation"),
    })


def intent_report(messages: DataFrame, session: str, text: str) -> DataFrame:
    """Messages, sessions and topic-bearing messages per intent of user messages.

    Reduced per (intent, session) first, so a frequent intent is spread out.
    """
    tagged = messages.where("role = 'user'").select(
        session, tx.intent(F.col(text)).alias("intent"), (F.size(tx.topics(F.col(text))) > 0).alias("on_topic")
    )
    per_session = tagged.groupBy("intent", session).agg(F.count("*").alias("n"), F.count_if("on_topic").alias("t"))
    return per_session.groupBy("intent").agg(
        F.sum("n").alias("messages"), F.count("*").alias("sessions"), F.sum("t").alias("with_topics")
    )
