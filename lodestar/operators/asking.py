"""From questions to contexts in one batch: retrieval, the gate, a second retrieval for the questions that need it, and the merge.

All questions take the first round together. The gate then picks those whose context is insufficient although concepts matched; only
their sub-queries are retrieved again, by a semi-join before the search, and merged behind what the first round found.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.operators import fusion
from lodestar.sources.store import written

#: How many times the first round's rows a question may have after the second.
SECOND_CAP = 2


class Asked:
    """What two rounds found: ``hits`` (query_id, doc_id, pos, round), the ``gate``'s row for each question, and the queries of the ``second`` round."""

    def __init__(self, hits: DataFrame, gate: DataFrame, second: DataFrame):
        self.hits, self.gate, self.second = hits, gate, second


def two_rounds(questions: DataFrame, expanded: DataFrame, matches: DataFrame, sub_queries: DataFrame, retrieve: Callable[[DataFrame], DataFrame], texts: DataFrame, k: int, scale: float = 1.0) -> Asked:
    """Contexts of questions (query_id, query).

    ``expanded`` (query_id, query_idx, query) are the forms in which a question is sought; its lists are taken in turns, up to k.
    ``matches`` (query_id) are questions that a concept matched, ``sub_queries`` (query_id, query_idx, query) what such a question is taken
    apart into. ``retrieve`` makes (query_id, doc_id, score, rank) of (query_id, query) in one plan. The gate sees scores times
    ``scale`` and ``texts`` (doc_id, text). A question with no sub-query, or a sufficient one, keeps its first round; others go up to SECOND_CAP times k,
    first what the first round found, then the sub-queries' rows in their order. The first round is stored, as gate and merge both read it.
    """
    first = written(_in_turns(expanded, retrieve, k), "first-round")
    gate = written(fusion.quality_gate(first.join(texts, "doc_id").withColumn("score", F.col("score") * scale), questions), "gate")
    open_ = gate.where("decision = 'insufficient'").join(matches.select("query_id").distinct(), "query_id", "left_semi").select("query_id")
    second = sub_queries.join(open_, "query_id", "left_semi")
    found = _by_query(second, retrieve)
    rows = first.select("query_id", "doc_id", F.lit(0).alias("round"), F.lit(-1).alias("part"), "pos").union(found.select("query_id", "doc_id", F.lit(1), "query_idx", "rank"))
    once = rows.groupBy("query_id", "doc_id").agg(F.min(F.struct("round", "part", "pos")).alias("at"))
    own = Window.partitionBy("query_id")
    placed = once.withColumn("pos", F.row_number().over(own.orderBy("at"))).where(F.col("pos") <= SECOND_CAP * k)
    return Asked(placed.select("query_id", "doc_id", "pos", (F.col("at.round") + 1).alias("round")), gate, second)


def _by_query(asked: DataFrame, retrieve: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``retrieve``'s rows of queries (query_id, query_idx, query), with both ids."""
    named = asked.select(F.struct("query_id", "query_idx").alias("query_id"), "query")
    return retrieve(named).select("query_id.query_id", "query_id.query_idx", "doc_id", "score", "rank")


def _in_turns(asked: DataFrame, retrieve: Callable[[DataFrame], DataFrame], k: int) -> DataFrame:
    """(query_id, doc_id, pos, score): each question's lists taken in turns, up to k; a document has its best score."""
    lists = _by_query(asked, retrieve).withColumnRenamed("query_id", "group_id")
    best = lists.groupBy("group_id", "doc_id").agg(F.max("score").alias("score"))
    return fusion.round_robin(lists, k).join(best, ["group_id", "doc_id"]).withColumnRenamed("group_id", "query_id")
