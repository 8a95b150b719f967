"""Prompts and reports: contexts of numbered sources, definitions and history for a whole batch of questions, and reports by section.

Texts of instructions are the caller's: templates, catalogues of questions and addenda are tables or parameters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions.plugins import Completer, complete
from lodestar.functions.text import format_page_numbers, strip, truncate_definition
from lodestar.operators import dialogue
from lodestar.operators.fusion import document_order, lost_in_the_middle
from lodestar.operators.terms import LONG_DEFINITION

# Headings and labels of a prompt, the characters of a definition that are looked for in the context, and kinds left out.
CONTEXT, DEFINITIONS, HISTORY = "=== CONTEXT FROM CREDIT AGREEMENT ===\n", "\n=== RELEVANT DEFINITIONS ===", "\n=== PREVIOUS Q&A IN THIS SESSION ==="
QUESTION, TASK = "\n=== CURRENT QUESTION ===\n", "\n=== EXTRACTION TASK ===\n"
#: Templates of a report at most: they are joined with all documents by a broadcast.
MAX_TEMPLATES = 1000
OPENING, KNOWN_CHARS, LEFT_OUT = "Preamble and Recitals", 80, "miscellaneous"


def preamble(texts: DataFrame) -> DataFrame:
    """(doc, text, pages) of preambles that aren't blank, without white space at their ends."""
    return texts.withColumn("text", F.nullif(strip(F.col("text")), F.lit(""))).where("text IS NOT NULL")


def new_definitions(definitions: DataFrame, hits: DataFrame) -> DataFrame:
    """Definitions (query_id, pos, term, text) whose beginning stands in none of the query's chunks (query_id, pos, text)."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "text")))
    held = hits.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("_held"))
    return definitions.join(held, "query_id", "left").where(~F.contains(F.coalesce("_held", F.lit("")), F.substring("text", 1, KNOWN_CHARS))).drop("_held")


def numbered_sources(hits: DataFrame, opening: DataFrame | None = None, by_document: bool = False) -> DataFrame:
    """(query_id, number, doc_id, label, text): sources in the order of a prompt. The opening (query_id, pages, text) is the first; hits
    (query_id, doc_id, section_id, section_title, pages, text, score, and article, chunk_index if ``by_document``) follow, the best
    ones first and last, or in the order of their document."""
    placed = document_order(hits) if by_document else lost_in_the_middle(hits)
    label = F.concat("section_title", F.lit(" (Section "), "section_id", F.lit(", pp. "), format_page_numbers(F.col("pages")), F.lit(")"))
    rows = placed.select("query_id", F.col("place").alias("at"), F.col("doc_id").cast("string").alias("doc_id"), label.alias("label"), "text")
    if opening is not None:
        pages = F.coalesce(F.nullif(format_page_numbers(F.coalesce("pages", F.array().cast("array<int>"))), F.lit("")), F.lit("n/a"))
        rows = rows.union(preamble(opening).select("query_id", F.lit(0), F.lit(None).cast("string"), F.concat(F.lit(f"{OPENING} (pp. "), pages, F.lit(")")), "text"))
    return rows.withColumn("number", F.row_number().over(Window.partitionBy("query_id").orderBy("at"))).drop("at")


def _lines(rows: DataFrame, order: str, line: Column, name: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("t"))))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n").alias(name))


def contexts(questions: DataFrame, sources: DataFrame, definitions: DataFrame | None = None, concepts: DataFrame | None = None, history: DataFrame | None = None, task: bool = False) -> DataFrame:
    """(query_id, prompt) of questions (query_id, question): numbered sources, definitions (query_id, pos, term, text) cut at a sentence,
    or hard for a task, the context of concepts (query_id, context), recent pairs (query_id, turn, question, answer), and the question."""
    out = questions.join(_lines(sources, "number", F.concat(F.lit("[Source "), "number", F.lit("] "), "label", F.lit("\n"), "text", F.lit("\n")), "_sources"), "query_id", "left")
    parts = [F.lit(CONTEXT), F.col("_sources")]
    if definitions is not None:
        cut = F.substring("text", 1, LONG_DEFINITION) if task else truncate_definition(F.col("text"))
        out = out.join(_lines(definitions, "pos", F.concat(F.lit('"'), "term", F.lit('" means '), cut), "_definitions"), "query_id", "left")
        parts.append(F.concat(F.lit(f"{DEFINITIONS}\n"), "_definitions"))
    if concepts is not None:
        out = out.join(concepts.select("query_id", F.concat(F.lit("\n"), "context").alias("_concepts")), "query_id", "left")
        parts.append(F.col("_concepts"))
    if history is not None:
        recent = dialogue.recent(history.withColumnRenamed("query_id", "conv_id")).withColumnRenamed("conv_id", "query_id")
        out = out.join(_lines(recent, "turn", F.concat(F.lit("User: "), "question", F.lit("\nAssistant: "), "answer"), "_history"), "query_id", "left")
        parts.append(F.concat(F.lit(f"{HISTORY}\n"), "_history"))
    parts.append(F.concat(F.lit(TASK if task else QUESTION), "question"))
    return out.select("query_id", F.concat_ws("\n", *parts).alias("prompt"))


def reformulation_prompts(questions: DataFrame, history: DataFrame) -> DataFrame:
    """(query_id, prompt) that asks for a question (query_id, question) on its own from pairs (query_id, turn, question, answer); only
    questions with a history have one."""
    told = _lines(history, "turn", F.concat(F.lit("User: "), "question", F.lit("\nAssistant: "), "answer"), "_told")
    return questions.join(told, "query_id").select("query_id", F.concat(F.lit("Conversation:\n"), "_told", F.lit("\n\nLatest question: "), "question", F.lit("\n\nReformulated search query:")).alias("prompt"))


def instructions(base: str, addenda: dict[str, str], flags: dict[str, Column], tokens: int, doubled: str = "commentary") -> tuple[Column, Column]:
    """(text, most tokens): the base and the addenda whose flags hold, in the order of ``addenda``; one of them doubles the tokens."""
    text = F.concat(F.lit(base), *[F.when(flags[k], F.lit(t)).otherwise(F.lit("")) for k, t in addenda.items() if k in flags])
    return text, F.when(flags[doubled], 2 * tokens).otherwise(tokens) if doubled in flags else F.lit(tokens)


def decomposed(questions: DataFrame, gate: DataFrame, matches: DataFrame, sub_queries: DataFrame) -> DataFrame:
    """(query_id, query_idx, query): sub-queries (query_id, query_idx, query) of questions whose context a gate (query_id, decision) found
    insufficient although concepts (query_id) matched; other questions, and those without sub-queries, stand for themselves."""
    open_ = gate.where("decision = 'insufficient'").join(matches.select("query_id").distinct(), "query_id", "left_semi").select("query_id")
    parts = sub_queries.join(open_, "query_id", "left_semi").select("query_id", "query_idx", "query")
    rest = questions.join(parts.select("query_id").distinct(), "query_id", "left_anti")
    return parts.union(rest.select("query_id", F.lit(0), F.col("question").alias("query")))


def report_queries(templates: DataFrame, documents: DataFrame) -> DataFrame:
    """(report_id, section_number, query_idx, query, section_filter, exclude, top_k) of all documents (report_id): templates
    (section_number, title, top_k, queries array of (query, section_filter)). Queries without a filter leave one kind out."""
    if templates.limit(MAX_TEMPLATES + 1).count() > MAX_TEMPLATES:
        raise ValueError(f"a report has at most {MAX_TEMPLATES} templates")
    each = templates.select("section_number", "top_k", F.posexplode("queries").alias("query_idx", "q"))
    each = each.select("section_number", "query_idx", "q.query", "q.section_filter", F.when(F.col("q.section_filter").isNull(), F.array(F.lit(LEFT_OUT))).alias("exclude"), "top_k")
    return documents.select("report_id").crossJoin(F.broadcast(each)).select("report_id", *each.columns)


def generated(prompts: DataFrame, make: Callable[[], Completer]) -> DataFrame:
    """(report_id, section_number, title, body, status, error): all sections of all reports in one job. A failing section is a row with
    status error; the others aren't stopped."""
    made = complete(prompts, make)
    failed = F.col("status") == "error"
    return made.select("report_id", "section_number", "title", F.when(~failed, F.col("text")).alias("body"), "status", F.when(failed, F.col("text")).alias("error"))


def regenerated(sections: DataFrame, fresh: DataFrame) -> DataFrame:
    """``sections`` with the rows of ``fresh`` in place of theirs of the same report and number."""
    return sections.join(fresh.select("report_id", "section_number"), ["report_id", "section_number"], "left_anti").unionByName(fresh)


def markdown_reports(sections: DataFrame, heads: DataFrame) -> DataFrame:
    """(report_id, markdown) of sections (report_id, section_number, title, body, status, error, confidence, sources array of (section_id,
    pages)) and heads (report_id, heading, closing): sections by number; one that failed shows its error, one that is pending says so."""
    cited = F.array_join(F.transform("sources", lambda s: F.concat(F.lit("Section "), s["section_id"], F.when(F.size(s["pages"]) > 0, F.concat(F.lit(" (pp. "), F.array_join(s["pages"].cast("array<string>"), ", "), F.lit(")"))).otherwise(""))), ", ")
    done = F.concat("body", F.lit("\n\nConfidence: "), "confidence", F.when(F.size("sources") > 0, F.concat(F.lit("\nSources: "), cited)).otherwise(""))
    text = F.when(F.col("status") == "error", F.concat(F.lit("GENERATION ERROR: "), "error")).when(F.col("status") == "pending", F.lit("(Not yet generated)")).otherwise(done)
    part = F.concat(F.lit("\n---\n\n## Section "), "section_number", F.lit(": "), "title", F.lit("\n\n"), text)
    ordered = F.array_sort(F.collect_list(F.struct("section_number", part.alias("t"))))
    body = sections.groupBy("report_id").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n").alias("_body"))
    return heads.join(body, "report_id", "left").select("report_id", F.concat_ws("\n", "heading", "_body", F.concat(F.lit("\n---\n"), "closing", F.lit("\n"))).alias("markdown"))


def shown_hits(hits: DataFrame) -> DataFrame:
    """(query_id, place, section, title, relevance, pages) of found chunks, the most relevant first."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return hits.select("query_id", place.alias("place"), F.col("section_id").alias("section"), F.col("section_title").alias("title"), F.round("score", 3).alias("relevance"), F.array_join(F.col("pages").cast("array<string>"), ", ").alias("pages"))
