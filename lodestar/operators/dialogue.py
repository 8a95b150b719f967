"""Conversations: question and answer pairs, recent history, prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Turns of history in a prompt, and characters of an answer there.
HISTORY_TURNS, ANSWER_CHARS = 3, 800


def pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, question, answer): each user turn with the next assistant turn before another question."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    asked = F.last(F.when(F.col("role") == "user", F.struct("turn", "text")), ignorenulls=True).over(order)
    answers = turns.withColumn("q", asked).where((F.col("role") == "assistant") & F.col("q").isNotNull() & (F.length("text") > 0))
    first = answers.groupBy("conv_id", F.col("q.turn").alias("turn"), F.col("q.text").alias("question")).agg(F.min_by("text", "turn").alias("answer"))
    return first


def recent(history: DataFrame, n: int = HISTORY_TURNS) -> DataFrame:
    """The last n pairs of each conversation, answers cut to ANSWER_CHARS."""
    last = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    cut = F.when(F.length("answer") > ANSWER_CHARS, F.concat(F.substring("answer", 1, ANSWER_CHARS), F.lit("..."))).otherwise(F.col("answer"))
    return history.withColumn("back", last).where(F.col("back") <= n).withColumn("answer", cut)


def history_prompt(history: DataFrame) -> DataFrame:
    """(conv_id, prompt): recent pairs, oldest first."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "question", "answer")))
    lines = F.transform(ordered, lambda x: F.concat(F.lit("Q: "), x["question"], F.lit("\nA: "), x["answer"]))
    return recent(history).groupBy("conv_id").agg(F.array_join(lines, "\n\n").alias("prompt"))


def numbered_context(hits: DataFrame) -> DataFrame:
    """(query_id, context): texts of hits (query_id, place, doc_id, text) as numbered sources in the order of ``place``."""
    ordered = F.array_sort(F.collect_list(F.struct("place", "doc_id", "text")))
    lines = F.transform(ordered, lambda x, i: F.concat(F.lit("[Source "), i + 1, F.lit(": "), x["doc_id"], F.lit("]\n"), x["text"]))
    return hits.groupBy("query_id").agg(F.array_join(lines, "\n\n").alias("context"))
