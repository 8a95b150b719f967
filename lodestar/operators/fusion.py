"""Merging, filtering and reordering ranked lists; every list is a table with a rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions.answers import with_synonyms
from lodestar.functions.text import gate_terms, terms_overlap
from lodestar.operators.lexical import EXACT
from lodestar.operators.segments import SIBLING_TOKENS, within_budget

# The rank constant, score limits and the gate's thresholds.
RRF_K, MIN_SCORE, FLOOR_ROWS = 50, 0.15, 3
GATE_TOP, GATE_MEAN, GATE_OVERLAP = 0.35, 0.25, 0.3
#: A sibling's share of the score of the hit it stands beside.
SIBLING_SHARE = 0.9


def reciprocal_ranks(vector: DataFrame, lexical: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, source, pos): sums of 1 / (RRF_K + rank) over both lists (query_id, doc_id, rank from 1)."""
    both = vector.select("query_id", "doc_id", "rank", F.lit("vector").alias("source")).union(lexical.select("query_id", "doc_id", "rank", F.lit("bm25")))
    merged = both.groupBy("query_id", "doc_id").agg(F.sum(1 / (RRF_K + F.col("rank"))).alias("score"), F.when(F.count(F.lit(1)) > 1, "both").otherwise(F.min("source")).alias("source"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", EXACT)), "doc_id"))
    return merged.withColumn("pos", place).where(F.col("pos") <= k).withColumn("score", F.round("score", 8))


def round_robin(lists: DataFrame, k: int) -> DataFrame:
    """(group_id, doc_id, pos): ranked lists (group_id, query_idx, rank, doc_id) taken in turns, each document once, at most k."""
    first = lists.groupBy("group_id", "doc_id").agg(F.min(F.struct("rank", "query_idx")).alias("turn"))
    place = F.row_number().over(Window.partitionBy("group_id").orderBy("turn.rank", "turn.query_idx"))
    return first.withColumn("pos", place).where(F.col("pos") <= k).select("group_id", "doc_id", "pos")


def score_floor(hits: DataFrame, least: float = MIN_SCORE, floor: int = FLOOR_ROWS) -> DataFrame:
    """Hits (query_id, pos, score, chunk_type) that score enough or are definitions; the first ``floor`` if fewer remain or are there at all."""
    every = Window.partitionBy("query_id")
    fine = (F.col("score") >= least) | (F.col("chunk_type") == "definition")
    marked = hits.withColumn("_fine", fine).withColumn("_kept", F.sum(fine.cast("int")).over(every)).withColumn("_n", F.count(F.lit(1)).over(every))
    keep = F.when(F.col("_n") <= floor, True).when(F.col("_kept") < floor, F.col("pos") <= floor).otherwise(F.col("_fine"))
    return marked.where(keep).drop("_fine", "_kept", "_n")


def quality_gate(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """One row per query (query_id, query) over hits (query_id, pos, score, text): best score, mean of the best three, share of the
    query's terms that the first five texts hold, and the decision."""
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "pos"))
    tops = hits.withColumn("_best", best).groupBy("query_id").agg(
        F.max("score").alias("top"), F.avg(F.when(F.col("_best") <= 3, F.col("score"))).alias("mean3"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("pos") <= 5, F.struct("pos", "text")))), lambda x: x["text"]), " ").alias("texts"))
    joined = queries.join(tops, "query_id", "left").withColumn("terms", gate_terms(F.col("query")))
    held = F.size(F.filter("terms", lambda t: F.contains(F.lower(F.coalesce("texts", F.lit(""))), t)))
    share = F.when(F.size("terms") == 0, 1.0).otherwise(held / F.size("terms"))
    fine = (F.col("top") >= GATE_TOP) & (F.col("mean3") >= GATE_MEAN) & (share >= GATE_OVERLAP)
    return joined.select("query_id", F.round("top", 5).alias("top"), F.round("mean3", 5).alias("mean3"), F.round(share, 5).alias("overlap"), F.when(fine, "sufficient").otherwise("insufficient").alias("decision"))


def lost_in_the_middle(hits: DataFrame) -> DataFrame:
    """``place`` of hits (query_id, score, doc_id): the best first and last, the weakest in the middle; two or fewer keep their order."""
    r = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    key = F.when((F.col("n") <= 2) | (F.col("r") % 2 == 1), F.col("r")).otherwise(2 * F.col("n") + 2 - F.col("r"))
    return hits.withColumn("r", r).withColumn("n", n).withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(key))).drop("r", "n")


def merge_results(existing: DataFrame, new: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, pos): existing rows in order, then new ones that aren't there, up to k."""
    both = existing.select("query_id", "doc_id", F.lit(0).alias("turn"), "pos").union(new.select("query_id", "doc_id", F.lit(1), "pos"))
    first = both.groupBy("query_id", "doc_id").agg(F.min(F.struct("turn", "pos")).alias("at"))
    return first.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("at.turn", "at.pos"))).where(F.col("pos") <= k).select("query_id", "doc_id", "pos")


def insert_within(hits: DataFrame, candidates: DataFrame, k: int, definitions: bool = False) -> DataFrame:
    """(query_id, pos, doc_id, section, score, definition): candidates (query_id, pos, doc_id, section, score) put into hits of at most k
    rows, in order: appended while there is room, else in place of the weakest row that is no definition and of another section, if
    that isn't stronger. Candidates that are ``definitions`` replace the weakest row that is none, whatever its section and
    score. A query's rows are folded together; there are k and a few more."""
    row = ("doc_id", "section", "score", "definition")
    ordered = lambda frame, name: frame.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", *row))).alias(name))
    both = ordered(hits, "held").join(ordered(candidates.withColumn("definition", F.lit(definitions)), "new"), "query_id", "left")

    def put(held, x):
        kept = lambda h: h["definition"] if definitions else h["definition"] | (h["section"] == x["section"])
        open_to = F.filter(F.transform(held, lambda h, i: F.struct(h["score"].alias("score"), i.alias("i"), kept(h).alias("kept"))), lambda h: ~h["kept"])
        weakest = F.array_min(open_to)
        swaps = lambda i: (i == weakest["i"]) & (F.lit(definitions) | (x["score"] >= weakest["score"]))
        swapped = F.transform(held, lambda h, i: F.when(swaps(i), x).otherwise(h))
        return F.when(F.size(held) < k, F.array_append(held, x)).when(weakest.isNull(), held).otherwise(swapped)

    made = F.when(F.col("new").isNull(), F.col("held")).otherwise(F.aggregate("new", F.col("held"), put))
    return both.select("query_id", F.posexplode(made).alias("at", "x")).select("query_id", (F.col("at") + 1).alias("pos"), *(F.col(f"x.{c}").alias(c) for c in row))


def document_order(hits: DataFrame) -> DataFrame:
    """``place`` of hits (query_id, article, section_id, chunk_index) in the order of their document; section ids compare as text."""
    return hits.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("article", "section_id", "chunk_index")))


def siblings(hits: DataFrame, chunks: DataFrame, queries: DataFrame, share: float = SIBLING_SHARE) -> DataFrame:
    """(query_id, pos, doc_id, section, score): chunks of the hits' sections that aren't among the hits and share a word with the query.

    ``hits`` (query_id, pos, doc_id, section, score, definition), ``chunks`` (doc_id, section, chunk_index, n_tokens, text), ``queries``
    (query_id, query). A section is expanded by its first hit that is no definition, in the order of its chunks, up to
    SIBLING_TOKENS words; a chunk that doesn't fit is passed over. Siblings have ``share`` of that hit's score.
    """
    first = hits.where("NOT definition").groupBy("query_id", "section").agg(F.min(F.struct("pos", "score")).alias("by"))
    near = first.join(chunks, "section").join(hits.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").join(queries, "query_id")
    near = near.where(terms_overlap(F.col("query"), F.col("text"), 1, with_synonyms))
    items = F.array_sort(F.collect_list(F.struct("chunk_index", "doc_id", F.col("n_tokens").alias("n"))))
    kept = near.groupBy("query_id", "section", "by").agg(within_budget(F.transform(items, lambda x: F.struct(x["doc_id"].alias("key"), x["n"].alias("n"))), SIBLING_TOKENS).alias("taken"))
    each = kept.select("query_id", "section", "by", F.posexplode("taken").alias("i", "doc_id"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("by.pos", "i"))
    return each.select("query_id", place.alias("pos"), "doc_id", "section", (F.col("by.score") * share).alias("score"))
