"""Definitions beside retrieved chunks: which terms a question needs, what they refer to, and how their texts come into the context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions.answers import query_keywords
from lodestar.operators.fusion import insert_within
from lodestar.operators.terms import GRAM, LONG_DEFINITION, found_terms, term_scores

# Terms that are injected, slots for those they refer to at least, and the share of the median score of a promoted chunk.
INJECTED, MORE_SLOTS, PROMOTED = 12, 6, 0.95


def definition_chunks(chunks: DataFrame, doc_col: str) -> DataFrame:
    """(doc, term, chunk_id): the first chunk of definitions that has each term."""
    each = chunks.where("chunk_type = 'definition'").select(doc_col, "chunk_id", "chunk_index", F.explode("terms").alias("term"))
    return each.groupBy(doc_col, "term").agg(F.min_by("chunk_id", F.struct("chunk_index", "chunk_id")).alias("chunk_id"))


def keyword_terms(queries: DataFrame, definitions: DataFrame, doc_col: str) -> DataFrame:
    """(query_id, doc, term): terms of the query's document whose names hold one of its keywords. Keywords are joined on their first
    characters with all such runs of the names."""
    asked = queries.select("query_id", doc_col, F.explode(query_keywords(F.col("query"))).alias("word")).withColumn("gram", F.substring("word", 1, GRAM))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length("term") - GRAM + 1, F.lit(1))), lambda k: F.substring(F.lower("term"), k, F.lit(GRAM)))
    names = definitions.select(doc_col, "term", F.explode(F.array_distinct(grams)).alias("gram"))
    return asked.join(names, [doc_col, "gram"]).where(F.contains(F.lower("term"), F.col("word"))).select("query_id", doc_col, "term").distinct()


def candidate_terms(queries: DataFrame, hits: DataFrame, chunk_terms: DataFrame, definitions: DataFrame, with_chunk: DataFrame, ubiquitous: DataFrame, doc_col: str) -> DataFrame:
    """(query_id, doc, term, n, in_query, metadata, keyword, ubiquitous, length, has_chunk, score): terms of the chunks that were found for
    a query (query_id, doc, query), of the query, and those its keywords name.

    ``hits`` (query_id, doc, chunk_id, terms) are found chunks with the terms stored with them, ``chunk_terms`` (doc, chunk_id, term)
    the terms that chunks' texts name, ``with_chunk`` (doc, term) terms with a chunk, ``ubiquitous`` (doc, term) common ones.
    """
    keys = ["query_id", doc_col, "term"]
    zero, no = F.lit(0).cast("long"), F.lit(False)
    row = lambda n, query, metadata, keyword: [n.alias("n"), query.alias("in_query"), metadata.alias("metadata"), keyword.alias("keyword")]
    counted = hits.select("query_id", doc_col, "chunk_id").distinct().join(chunk_terms, [doc_col, "chunk_id"]).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select(*keys, *row(F.col("n"), no, no, no))
    asked = found_terms(queries.select("query_id", doc_col, F.col("query").alias("text")), definitions, "query_id", doc_col).select(*keys, *row(zero, F.lit(True), no, no))
    stored = hits.select("query_id", doc_col, F.explode("terms").alias("term")).distinct().select(*keys, *row(zero, no, F.lit(True), no))
    named = keyword_terms(queries, definitions, doc_col).select(*keys, *row(zero, no, no, F.lit(True)))
    one = counted.union(asked).union(stored).union(named).groupBy(*keys).agg(F.sum("n").alias("n"), *(F.bool_or(c).alias(c) for c in ("in_query", "metadata", "keyword")))
    marked = one.join(definitions.select(doc_col, "term", F.length("text").alias("length")), [doc_col, "term"], "left")
    marked = marked.join(ubiquitous.select(doc_col, "term", F.lit(True).alias("u")), [doc_col, "term"], "left").join(with_chunk.select(doc_col, "term", F.lit(True).alias("c")), [doc_col, "term"], "left")
    marked = marked.select(*keys, "n", "in_query", "metadata", "keyword", F.coalesce("u", no).alias("ubiquitous"), F.coalesce("c", no).alias("has_chunk"), F.col("length").alias("all"))
    return term_scores(marked.withColumn("length", F.when(F.col("has_chunk"), F.coalesce("all", F.lit(0))).otherwise(0))).withColumn("length", F.col("all")).drop("all")


def _ranked(frame: DataFrame, *by: Column) -> DataFrame:
    return frame.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*by, F.desc(F.length("term")), "term")))


def injected_terms(scored: DataFrame, references: DataFrame, doc_col: str, most: int = INJECTED, more: int = MORE_SLOTS) -> DataFrame:
    """(query_id, doc, term, tier, rank, in_query, ubiquitous, has_chunk, length): the best terms of a query (tier 0), then terms stored
    with its chunks that didn't come among them (tier 1), then those that both kinds refer to most (tier 2). ``references``
    (doc, term, ref) are the terms that definitions name. One step of references is followed."""
    keys = ["query_id", doc_col, "term"]
    real = scored.where((F.col("n") > 0) | F.col("in_query") | F.col("keyword"))
    primary = _ranked(real, F.desc("score")).where(F.col("rank") <= most).where("length IS NOT NULL").select(*keys, "rank")
    rest = scored.where("metadata AND NOT ubiquitous AND length IS NOT NULL").join(primary.select(*keys), keys, "left_anti")
    sources = primary.select(*keys, F.lit(0).alias("own")).union(rest.select(*keys, F.lit(1)))
    named = sources.join(references, [doc_col, "term"]).select("query_id", doc_col, F.col("ref").alias("term"))
    counted = named.union(rest.select(*keys)).join(primary.select(*keys), keys, "left_anti").groupBy(*keys).agg(F.count(F.lit(1)).alias("times"))
    slots = scored.select("query_id").distinct().join(primary.groupBy("query_id").agg(F.count(F.lit(1)).alias("have")), "query_id", "left").select("query_id", F.greatest(most - F.coalesce("have", F.lit(0)), F.lit(more)).alias("slots"))
    first = _ranked(rest, F.desc("score")).join(slots, "query_id").where(F.col("rank") <= F.col("slots")).select(*keys, "rank")
    left = slots.join(first.groupBy("query_id").agg(F.count(F.lit(1)).alias("used")), "query_id", "left").select("query_id", (F.col("slots") - F.coalesce("used", F.lit(0))).alias("slots"))
    second = _ranked(counted.join(first.select(*keys), keys, "left_anti"), F.desc("times")).join(left, "query_id").where(F.col("rank") <= F.col("slots")).select(*keys, "rank")
    tiers = primary.select(*keys, F.lit(0).alias("tier"), "rank").union(first.select(*keys, F.lit(1), "rank")).union(second.select(*keys, F.lit(2), "rank"))
    return tiers.join(scored.select(*keys, "in_query"), keys, "left").withColumn("in_query", F.coalesce("in_query", F.lit(False)))


def definitions_of(terms: DataFrame, definitions: DataFrame, doc_col: str) -> DataFrame:
    """``terms`` (doc, term, ...) with the text of their definitions; terms without one are left out."""
    return terms.join(definitions.select(doc_col, "term", "text"), [doc_col, "term"])


def injected_or_promoted(terms: DataFrame, definitions: DataFrame, with_chunk: DataFrame, ubiquitous: DataFrame, hits: DataFrame, doc_col: str) -> tuple[DataFrame, DataFrame]:
    """((query_id, doc, term, text) that are injected whole, (query_id, doc, term, chunk_id) that come as chunks): long definitions with a
    chunk are promoted, unless it is there; common terms only if the query names them."""
    rows = definitions_of(terms, definitions, doc_col).join(with_chunk, [doc_col, "term"], "left").join(ubiquitous.select(doc_col, "term", F.lit(True).alias("u")), [doc_col, "term"], "left")
    rows = rows.where(F.col("u").isNull() | F.col("in_query"))
    long = (F.length("text") > LONG_DEFINITION) & F.col("chunk_id").isNotNull()
    promoted = rows.where(long).join(hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    return rows.where(~long).select("query_id", doc_col, "term", "text"), promoted.select("query_id", doc_col, "term", "chunk_id")


def promote(hits: DataFrame, promoted: DataFrame, k: int) -> DataFrame:
    """(query_id, pos, doc_id, section, score, definition): hits with promoted chunks (query_id, pos, doc_id, section) at a share of the
    median score: appended while there is room, else in place of the weakest row that is no definition."""
    middle = hits.groupBy("query_id").agg((F.median("score") * PROMOTED).alias("score"))
    return insert_within(hits, promoted.join(middle, "query_id"), k, definitions=True)
