"""Citations in answers: markers, sources, pages and renumbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions.answers import KEYWORD_CHARS, NEARBY_SECTION, SECTION_CHARS, keywords, marker_windows, once, renumbered, section_candidates
from lodestar.functions.text import CITATION, MARKER, format_page_numbers, parse_page_numbers, snippet, targeted_snippet


def markers(answers: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, number, pos): each marker [n] of an answer at its first place."""
    found = answers.select(id_col, F.posexplode(F.regexp_extract_all(text_col, F.lit(MARKER), 1)).alias("pos", "number"))
    return found.groupBy(id_col, F.col("number").cast("int").alias("number")).agg(F.min("pos").alias("pos"))


def renumber(answers: DataFrame, sources: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, number, source, new_number): markers that have a source (id, number, source), numbered anew by first appearance."""
    found = markers(answers, id_col, text_col).join(sources, [id_col, "number"])
    return found.withColumn("new_number", F.row_number().over(Window.partitionBy(id_col).orderBy("pos"))).drop("pos")


def cited_sources(answers: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, section_id, pages): sections that an answer cites, once each, with all their pages."""
    ids, pages = (F.regexp_extract_all(text_col, F.lit(CITATION), k) for k in (1, 2))
    each = answers.select(id_col, F.explode(F.arrays_zip(ids.alias("section_id"), pages.alias("pages"))).alias("c"))
    numbers = F.flatten(F.collect_list(parse_page_numbers(F.coalesce("c.pages", F.lit("")))))
    return each.groupBy(id_col, F.rtrim(F.col("c.section_id"), F.lit(".")).alias("section_id")).agg(format_page_numbers(numbers).alias("pages"))


def best_by_section(hits: DataFrame, order: str = "pos") -> DataFrame:
    """One row per (query_id, section_id): the first hit."""
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "section_id").orderBy(order))).where("_n = 1").drop("_n")


def with_parents(sections: DataFrame, id_col: str = "section_id") -> DataFrame:
    """``candidate`` and ``depth`` for each row: the id, then the id without its last parenthesis, and so on."""
    n = F.size(F.regexp_extract_all(id_col, F.lit(r"\([A-Za-z0-9]+\)"), 0))
    cut = F.transform(F.sequence(F.lit(0), n), lambda d: F.regexp_replace(F.col(id_col), F.concat(F.lit(r"(\([A-Za-z0-9]+\)){"), d, F.lit("}$")), F.lit("")))
    return sections.select("*", F.posexplode(cut).alias("depth", "candidate"))


def numbered_rows(answers: DataFrame, made, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, pos, ...): the array of structs that ``made(text)`` gives, a row each."""
    return answers.select(id_col, F.posexplode(made(F.col(text_col))).alias("pos", "_c")).select(id_col, "pos", "_c.*")


def rewritten(answers: DataFrame, sources: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, body, numbers): answers whose markers [n] are numbered anew by first appearance among their sources (id, number)."""
    counted = sources.groupBy(id_col).agg(F.max("number").alias("_n"))
    made = renumbered(F.col(text_col), F.coalesce("_n", F.lit(0)))
    return answers.join(counted, id_col, "left").select(id_col, made.alias("_r")).select(id_col, "_r.body", "_r.numbers")


def _with_hits(rows: DataFrame, chunks: DataFrame, id_col: str, fields: list) -> DataFrame:
    """``rows`` (id, section_id) with ``hits``: the chunks, as structs of ``fields`` (match, ...), of the nearest of the section and those it
    stands in that has any; null without. An answer's chunks are few, so they stand in one array and rows are joined by id alone."""
    every = chunks.groupBy(id_col).agg(F.collect_list(F.struct(*fields)).alias("_every"))
    known = lambda c: F.exists("_every", lambda x: x["match"] == c)
    nearest = F.get(F.filter(section_candidates(F.col("section_id")), known), F.lit(0))
    found = once(nearest, lambda m: F.when(m.isNotNull(), F.filter("_every", lambda x: x["match"] == m)))
    return rows.join(every, id_col, "left").withColumn("hits", found).drop("_every")


def enriched(cited: DataFrame, chunks: DataFrame, id_col: str) -> DataFrame:
    """(id, pos, section_id, section_title, pages, snippet): citations (id, pos, section_id, pages) with the best chunk (id, pos, section_id,
    section_title, pages, score, text) of their section or of the nearest one it stands in. Citations of one section become
    one with all pages; the first of them takes its chunk's pages if it has none."""
    fields = [F.col("section_id").alias("match"), (-F.col("score")).alias("s"), "pos", "section_title", "pages", "text"]
    held = _with_hits(cited, chunks, id_col, fields).withColumn("hit", F.array_min("hits"))
    own = F.col("first.pages")
    one = held.groupBy(id_col, "section_id").agg(F.min(F.struct("pos", "pages")).alias("first"), F.flatten(F.collect_list("pages")).alias("all"), F.first("hit").alias("hit"))
    pages = F.when(F.size(own) > 0, F.col("all")).otherwise(F.concat(F.coalesce("hit.pages", F.array().cast("array<int>")), "all"))
    return one.select(id_col, F.col("first.pos").alias("pos"), "section_id", F.coalesce("hit.section_title", F.lit("")).alias("section_title"), F.array_sort(F.array_distinct(pages)).alias("pages"), F.coalesce(snippet(F.col("hit.text")), F.lit("")).alias("snippet"))


def enriched_inline(cited: DataFrame, chunks: DataFrame, bodies: DataFrame, id_col: str) -> DataFrame:
    """(id, number, section_id, section_title, pages, snippet): references (id, number, section_id, pages, quote) with the chunk of their
    section that holds most of the words near the marker in the body (id, body), the first of equals; where none holds any, the
    best by score. The snippet is the quote, or the chunk around the earliest of the words."""
    near = bodies.select(id_col, F.posexplode(marker_windows(F.col("body"), KEYWORD_CHARS)).alias("at", "w")).select(id_col, "at", F.col("w.number").alias("number"), keywords(F.col("w.window")).alias("words"))
    near = near.groupBy(id_col).agg(F.collect_list(F.struct("number", "at", "words")).alias("_near"))
    fields = [F.col("section_id").alias("match"), F.col("pos").alias("at"), "section_title", F.col("pages").alias("own"), "score", "text", F.lower("text").alias("lower")]
    held = _with_hits(cited.join(near, id_col, "left"), chunks, id_col, fields)
    last = F.array_max(F.transform(F.filter("_near", lambda x: (x["number"] == F.col("number")) & (F.size(x["words"]) > 0)), lambda x: F.struct(x["at"], x["words"])))["words"]

    def rated(x: Column) -> Column:
        n = F.size(F.filter("lowered", lambda w: F.contains(x["lower"], w)))
        return once(n, lambda hits: F.struct((-hits).alias("h"), F.when(hits > 0, F.lit(0.0)).otherwise(-x["score"]).alias("s"), x["at"], x["section_title"], x["own"], x["text"]))

    held = held.withColumn("words", F.coalesce(last, F.array().cast("array<string>"))).withColumn("lowered", F.transform("words", F.lower))
    best = held.withColumn("hit", F.array_min(F.transform("hits", rated))).select(id_col, "number", "section_id", "pages", "quote", "words", "hit").distinct()
    found = F.col("hit.text").isNotNull()
    text = F.when(~found | (F.col("quote") != ""), F.col("quote")).otherwise(targeted_snippet(F.col("hit.text"), F.col("words")))
    return best.select(id_col, "number", "section_id", F.when(found, F.col("hit.section_title")).otherwise("").alias("section_title"), F.when((F.size("pages") > 0) | ~found, F.col("pages")).otherwise(F.col("hit.own")).alias("pages"), text.alias("snippet"))


def from_sources(bodies: DataFrame, sources: DataFrame, id_col: str) -> DataFrame:
    """(id, number, section_id): markers of bodies (id, body), each number once, tied to the source (id, pos, section_id) of the last
    section named shortly before it, or of one that section stands in; else to the source of the marker's own place."""
    every = sources.groupBy(id_col).agg(F.collect_list(F.struct("pos", "section_id")).alias("_every"))
    near = bodies.join(every, id_col, "left").select(id_col, "_every", F.posexplode(marker_windows(F.col("body"), SECTION_CHARS)).alias("at", "w"))
    # an answer's sources are few and stand in one array, so rows stay where the join by id has put them
    first = near.groupBy(id_col, F.col("w.number").alias("number")).agg(F.min_by("w.window", "at").alias("window"), F.first("_every").alias("_every"))
    named = first.select(id_col, "number", "_every", F.try_element_at(F.regexp_extract_all("window", F.lit(NEARBY_SECTION), 1), F.lit(-1)).alias("section_id"))
    known = lambda c: F.exists("_every", lambda x: x["section_id"] == c)
    nearest = F.when(F.col("section_id").isNotNull(), F.get(F.filter(section_candidates(F.col("section_id")), known), F.lit(0)))
    placed = F.get(F.filter("_every", lambda x: x["pos"] + 1 == F.col("number")), F.lit(0))["section_id"]
    return named.select(id_col, "number", F.coalesce(nearest, placed).alias("section_id")).where("section_id IS NOT NULL AND number IS NOT NULL")
