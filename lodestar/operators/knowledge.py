"""Concepts and synonyms: dimensions that questions are matched against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions.answers import baseline_queries
from lodestar.operators.terms import at_borders, held_phrases

# Search terms of a concept in one query, synonyms in a query, and queries with and without concepts.
TERMS_IN_QUERY, SYNONYMS_IN_QUERY, WITH_CONCEPTS, WITHOUT = 4, 3, 5, 3
#: Characters of a synonym at least.
LEAST = 3


def load_dimension(spark, path: str, columns: str, filled: tuple[str, ...] = ()) -> DataFrame:
    """A dimension from JSON lines without the rows that lack a name or a list among ``filled``, as both are of no use without."""
    rows = spark.read.schema(columns).json(path)
    for name in filled:
        empty = F.size(name) <= 0 if rows.schema[name].dataType.typeName() == "array" else F.col(name) == ""
        rows = rows.where(F.col(name).isNotNull() & ~empty)
    return rows


def concept_matches(questions: DataFrame, concepts: DataFrame) -> DataFrame:
    """(question_id, concept_id, alias): concepts (concept_id, alias) of which a question (question_id, question) has an alias between
    word borders: the one that stands first, the longest of those that start there."""
    found = held_phrases(questions.select("question_id", F.col("question").alias("text")), concepts.select(F.col("alias").alias("term")), "question_id")
    hits = found.withColumnRenamed("term", "alias").join(concepts.select("concept_id", F.lower("alias").alias("alias")).distinct(), "alias")
    asked = questions.select(F.col("question_id").alias("_id"), "question")
    placed = hits.join(asked, F.col("question_id").eqNullSafe(F.col("_id"))).withColumn("at", F.regexp_instr(F.lower("question"), at_borders(F.col("alias"))))
    first = F.min(F.struct("at", (-F.length("alias")).alias("n"), "alias"))
    return placed.groupBy("question_id", "concept_id").agg(first["alias"].alias("alias"))


def concept_context(matches: DataFrame, concepts: DataFrame) -> DataFrame:
    """(question_id, context): matched concepts (question_id, concept_id) in the order of the dimension (pos, concept_id, description,
    search_terms) as text for a prompt."""
    told = F.concat(F.lit("CONCEPT: "), F.initcap(F.replace("concept_id", F.lit("_"), F.lit(" "))), F.lit("\nDESCRIPTION: "), "description", F.lit("\nLOOK FOR: "), F.array_join("search_terms", ", "))
    each = matches.join(concepts, "concept_id").select("question_id", F.struct("pos", told.alias("t")).alias("x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "\n\n")
    return each.groupBy("question_id").agg(F.concat(F.lit("=== DOMAIN CONCEPT CONTEXT ===\n\n"), body).alias("context"))


def synonym_terms(questions: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(question_id, terms): terms of the groups (group_id, pos, term) that a question touches and doesn't hold itself, in the order of
    groups and of terms within. A question touches a group if it holds one of its terms of three characters or more anywhere."""
    asked = questions.select("question_id", F.lower("question").alias("text"))
    lower = synonyms.select("group_id", F.lower("term").alias("lower")).where(F.length("term") >= LEAST)
    starts = F.transform(F.sequence(F.lit(1), F.length("text") - LEAST + 1), lambda k: F.substring("text", k, F.lit(LEAST)))
    grams = asked.where(F.length("text") >= LEAST).select("question_id", "text", F.explode(F.array_distinct(starts)).alias("gram"))
    held = grams.join(lower.withColumn("gram", F.substring("lower", 1, LEAST)), "gram").where(F.contains("text", "lower"))
    touched = held.select("question_id", "group_id", "text").distinct()
    added = touched.join(synonyms, "group_id").where(~F.contains("text", F.lower("term")))
    ordered = F.array_sort(F.collect_list(F.struct("group_id", "pos", "term")))
    return added.groupBy("question_id").agg(F.transform(ordered, lambda x: x["term"]).alias("terms"))


def expanded_queries(questions: DataFrame, matches: DataFrame, search_terms: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(question_id, query_idx, query): the question, then its concepts' search terms (concept_id, pos, term) a few at a time, then the
    question with synonyms (question_id, terms), then its baseline queries. Repeats go; five queries if concepts matched, else
    three."""
    batch = F.floor((F.row_number().over(Window.partitionBy("concept_id").orderBy("pos")) - 1) / TERMS_IN_QUERY)
    batches = search_terms.withColumn("batch", batch).groupBy("concept_id", "batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]), " ").alias("query"))
    asked = questions.select("question_id", F.lit(0).alias("phase"), F.lit("").alias("concept_id"), F.lit(0).cast("long").alias("batch"), F.col("question").alias("query"))
    by_concept = matches.select("question_id", "concept_id").join(batches, "concept_id").select("question_id", F.lit(1), "concept_id", "batch", "query")
    some = F.array_join(F.slice("terms", 1, SYNONYMS_IN_QUERY), " ")
    by_synonym = questions.join(synonyms, "question_id").select("question_id", F.lit(2), F.lit(""), F.lit(0).cast("long"), F.concat_ws(" ", "question", some))
    baseline = questions.select("question_id", F.posexplode(baseline_queries(F.col("question"))).alias("batch", "query")).select("question_id", F.lit(3), F.lit(""), F.col("batch").cast("long"), "query")
    every = asked.union(by_concept).union(by_synonym).union(baseline)
    first = every.groupBy("question_id", "query").agg(F.min(F.struct("phase", "concept_id", "batch")).alias("at"))
    own = Window.partitionBy("question_id")
    ranked = first.withColumn("query_idx", F.row_number().over(own.orderBy("at")) - 1).withColumn("most", F.when(F.max(F.col("at.phase") == 1).over(own), WITH_CONCEPTS).otherwise(WITHOUT))
    return ranked.where(F.col("query_idx") < F.col("most")).select("question_id", "query_idx", "query")
