"""Documents to sections with pages and tables, and sections to chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions.answers import chunk_pages, clean_definition, once
from lodestar.functions.text import chunk_id, section_type, strip, word_count
from lodestar.operators import segments
from lodestar.operators.terms import named_terms

# Words of a definition that stands alone, and the titles of sections without a header.
ALONE_TOKENS = 50
PREAMBLE, FULL_DOCUMENT = "Preamble and Recitals", "Full Document"


def _page_of(starts: Column, offset: Column) -> Column:
    """The last page that starts at or before the offset; 1 if none does."""
    return F.coalesce(F.try_element_at(F.filter(starts, lambda s: s["offset"] <= offset), F.lit(-1))["page"], F.lit(1))


def _heads() -> Column:
    """The subsections' heads (id, title, at, label) of an article (number, start, body), in order: headers whose first part is its number.
    They stay in the article's row, so that no body is carried through a shuffle once for each of them."""

    def head(m: Column) -> Column:
        own = F.regexp_extract(m["part"], segments.SUBSECTION, 1)
        at = F.col("start") + m["offset"]
        title = F.rtrim(strip(F.regexp_extract(m["part"], segments.SUBSECTION, 2)), F.lit("."))
        label = at + F.regexp_instr(m["part"], F.lit(r"\d+\.\d+")) - 1
        return F.struct(F.when(own.startswith(F.concat(F.col("number").cast("string"), F.lit("."))), own).alias("id"), title.alias("title"), at.alias("at"), label.alias("label"))

    return F.filter(F.transform(segments.matches(F.col("body"), segments.SUBSECTION), head), lambda h: h["id"].isNotNull())


def _offsets(pages: Column, gap: int) -> Column:
    """Array of (offset, page) of ordered pages (page, n): where each starts, with ``gap`` characters after each that has a text."""
    state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<offset:bigint,page:int>>").alias("out"))
    step = lambda s, p: F.struct((s["at"] + F.coalesce(p["n"] + gap, F.lit(0))).alias("at"), F.array_append(s["out"], F.struct(s["at"].alias("offset"), p["page"].cast("int").alias("page"))).alias("out"))
    return F.aggregate(pages, state, step, lambda s: s["out"])


def sections(pages: DataFrame, doc_col: str) -> DataFrame:
    """(doc, ord, section_id, article_number, section_title, article_title, section_type, text, page_start, page_end, tables) of pages
    (doc, page, text, tables array): the preamble, then subsections of articles, or whole articles without any; a document without
    an article is one section. A section has the tables of its pages, but not those of a last page that the next section
    starts on. Pages meet once, in a row for each document; what follows stays where that shuffle has put it."""
    none = F.array().cast("array<string>")
    own = pages.where(F.col(doc_col).isNotNull()).groupBy(doc_col).agg(F.sort_array(F.collect_list(F.struct("page", "text", F.coalesce("tables", none).alias("t")))).alias("pages"))
    starts = _offsets(F.transform("pages", lambda p: F.struct(p["page"].alias("page"), F.length(p["text"]).alias("n"))), len(segments.PAGE_BREAK))
    tables = F.filter(F.sort_array(F.transform("pages", lambda p: F.struct(p["page"].cast("int").alias("page"), p["t"].alias("t")))), lambda p: F.size(p["t"]) > 0)
    texts = own.select(doc_col, F.array_join(F.transform("pages", lambda p: p["text"]), segments.PAGE_BREAK).alias("text"), starts.alias("starts"), tables.alias("_tables"))
    found = texts.select(doc_col, "text", "starts", "_tables", segments.article_heads(F.col("text")).alias("_articles"))
    part = lambda number, title, kind, start, end, then, body: F.struct(number.alias("number"), title.alias("article_title"), kind.alias("type"), start.alias("start"), end.alias("end"), then.alias("next_start"), body.alias("body"))
    fixed = lambda title, kind, end, body: part(F.lit(0), F.lit(title), F.lit(kind), F.lit(0), end, F.lit(None).cast("int"), body)
    first = F.get("_articles", F.lit(0))["start"]
    opening = once(strip(F.col("text").substr(F.lit(1), first)), lambda t: F.when(F.length(t) >= segments.MIN_PREAMBLE, F.array(fixed(PREAMBLE, "preamble", first, t))))
    article = lambda a: part(a["number"], a["title"], section_type(a["title"]), a["start"], a["end"], a["next"], F.col("text").substr(a["start"] + 1, a["end"] - a["start"]))
    articles = F.transform("_articles", article)
    parts = F.when(F.size("_articles") == 0, F.array(fixed(FULL_DOCUMENT, "other", F.length("text"), F.col("text")))).otherwise(F.concat(F.coalesce(opening, F.slice(articles, 1, 0)), articles))
    found = found.select(doc_col, "starts", "_tables", F.explode(parts).alias("a")).select(doc_col, "starts", "_tables", "a.*")
    found = found.select("*", F.when(F.col("number") > 0, _heads()).alias("heads"))

    section = lambda name, title, kind, text, begin, to, label: F.struct(name.alias("section_id"), title.alias("section_title"), kind.alias("section_type"), text.alias("text"), begin.alias("from"), to.alias("to"), label.alias("next_label"))

    def cut(h: Column, i: Column) -> Column:
        kind = F.coalesce(F.nullif(section_type(h["title"]), F.lit("other")), F.col("type"))
        stop = F.coalesce(F.get("heads", i + 1)["at"], "end")
        return section(h["id"], h["title"], kind, F.col("body").substr(h["at"] - F.col("start") + 1, stop - h["at"]), h["label"], stop, F.get("heads", i + 1)["label"])

    name = F.when(F.col("number") > 0, F.concat(F.lit("SECTION_"), "number")).when(F.col("type") == "preamble", "PREAMBLE").otherwise("FULL_DOC")
    whole = section(name, F.col("article_title"), F.col("type"), F.col("body"), F.col("start"), F.col("end"), F.col("next_start"))
    every = found.select(doc_col, "starts", "_tables", F.col("number").alias("article_number"), "article_title", F.explode(F.when(F.size("heads") > 0, F.transform("heads", cut)).otherwise(F.array(whole))).alias("s"))
    every = every.select(doc_col, "starts", "_tables", "article_number", "article_title", "s.*")
    last = _page_of(F.col("starts"), F.greatest(F.col("to") - 1, F.col("from")))
    last = F.when(F.col("section_id") == "FULL_DOC", F.element_at("starts", -1)["page"]).otherwise(last)
    begin = F.when(F.col("from") == 0, F.lit(1)).otherwise(_page_of(F.col("starts"), F.col("from")))
    placed = every.withColumn("page_start", begin).withColumn("page_end", last)
    shared = F.col("next_label").isNotNull() & (F.col("page_start") != F.col("page_end")) & (_page_of(F.col("starts"), F.col("next_label")) == F.col("page_end"))
    upto = F.greatest(F.col("page_end") - F.when(shared, 1).otherwise(0), "page_start")
    placed = placed.withColumn("_upto", upto)
    held = F.flatten(F.transform(F.filter("_tables", lambda p: p["page"].between(F.col("page_start"), F.col("_upto"))), lambda p: p["t"]))
    names = [doc_col, "section_id", "article_number", "section_title", "article_title", "section_type", "text", "page_start", "page_end", "from"]
    return placed.select(*names, held.alias("tables")).withColumn("ord", F.row_number().over(Window.partitionBy(doc_col).orderBy("from", "article_number", "section_id"))).drop("from")


def definitions(found: DataFrame, pages: DataFrame, doc_col: str) -> DataFrame:
    """(doc, ord, term, text, page) of the first definitions section of each document: bodies without noise, and the page each starts
    on, counted from the section's first page by the lengths of pages alone. The lengths of a document's pages stand in one array,
    which its section meets once."""
    nth = F.row_number().over(Window.partitionBy(doc_col).orderBy("ord"))
    first = found.where("section_type = 'definitions'").where(F.col(doc_col).isNotNull()).withColumn("_n", nth).where("_n = 1").select(doc_col, "text", "page_start", "page_end")
    sizes = pages.select(doc_col, "page", F.length("text").alias("n")).groupBy(doc_col).agg(F.sort_array(F.collect_list(F.struct("page", "n"))).alias("_pages"))
    own = _offsets(F.filter("_pages", lambda p: p["page"].between(F.col("page_start"), F.col("page_end"))), 0)
    rows = segments.definitions(first.join(sizes, doc_col, "left").select(doc_col, "text", own.alias("starts")), doc_col, with_offset=True, carried=("starts",))
    placed = rows.withColumn("page", _page_of(F.col("starts"), F.col("at")))
    return placed.select(doc_col, F.row_number().over(Window.partitionBy(doc_col).orderBy("at")).alias("ord"), "term", clean_definition(F.col("body")).alias("text"), "page")


def pack_definitions(items: Column, limit: int = segments.PACK_TOKENS, alone: int = ALONE_TOKENS) -> Column:
    """Array of (text, terms) of an ordered array of (term, text, n): definitions of ``alone`` words or more by themselves, shorter ones
    together up to ``limit``; what is held is handed on before one that stands alone."""
    chunk = "struct<text:string,terms:array<string>>"
    state = F.struct(F.array().cast(f"array<{chunk}>").alias("done"), F.array().cast("array<string>").alias("texts"), F.array().cast("array<string>").alias("terms"), F.lit(0).alias("n"))
    made = lambda texts, terms: F.struct(F.array_join(texts, "\n\n").alias("text"), terms.alias("terms"))
    flushed = lambda s: F.when(F.size(s["texts"]) > 0, F.array_append(s["done"], made(s["texts"], s["terms"]))).otherwise(s["done"])

    def step(s: Column, x: Column) -> Column:
        big = x["n"] >= alone
        full = big | ((F.size(s["texts"]) > 0) & (s["n"] + x["n"] > limit))
        done = F.when(full, flushed(s)).otherwise(s["done"])
        done = F.when(big, F.array_append(done, made(F.array(x["text"]), F.array(x["term"])))).otherwise(done)
        none = F.array().cast("array<string>")
        put = lambda held, v: F.when(big, none).when(full, F.array(v)).otherwise(F.array_append(held, v))
        return F.struct(done.alias("done"), put(s["texts"], x["text"]).alias("texts"), put(s["terms"], x["term"]).alias("terms"), F.when(big, 0).when(full, x["n"]).otherwise(s["n"] + x["n"]).alias("n"))

    return F.aggregate(items, state, step, flushed)


def chunks(found: DataFrame, defined: DataFrame, doc_col: str, limit: int = segments.PACK_TOKENS) -> DataFrame:
    """(doc, chunk_id, section_id, section_title, article_number, article_title, section_type, chunk_type, chunk_index, text, n_tokens,
    pages, terms) of sections and definitions: the first definitions section gives chunks of definitions, every other one a chunk
    for each table and then its text, whole if it has up to ``limit`` words, else cut with overlap."""
    names = ["section_id", "section_title", "article_number", "article_title", "section_type"]
    kind = F.coalesce(F.col("section_type") == "definitions", F.lit(False)) & F.col(doc_col).isNotNull() & F.col("ord").isNotNull()
    before = F.max(kind).over(Window.partitionBy(doc_col).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    items = F.sort_array(F.collect_list(F.struct("ord", "term", "text", word_count(F.col("text")).alias("n"))))
    packed = defined.where(F.col(doc_col).isNotNull()).groupBy(doc_col).agg(F.transform(items, lambda x: F.struct(x["term"], x["text"], x["n"])).alias("items"))
    packed = packed.select(doc_col, "items", F.array_distinct(F.filter(F.transform("items", lambda x: x["term"]), lambda t: t != "")).alias("_terms"))
    # definitions meet all sections of their document once, and what follows stays there
    marked = found.withColumn("_first", kind & ~F.coalesce(before, F.lit(False))).join(packed, doc_col, "left").withColumn("whole", F.when(F.col("_first"), F.col("text")).otherwise(strip(F.col("text"))))
    short = word_count(F.col("whole")) <= limit
    parts = F.when(F.col("whole") == "", F.array().cast("array<string>")).when(short, F.array("whole")).otherwise(segments.overlapping_chunks(F.col("whole"), limit))
    no_terms = F.lit(None).cast("array<string>").alias("terms")
    other = F.concat(F.transform("tables", lambda t: F.struct(F.lit("table").alias("chunk_type"), t.alias("text"), no_terms)), F.transform(parts, lambda t: F.struct(F.lit("text").alias("chunk_type"), t.alias("text"), no_terms)))
    by_term = F.transform(pack_definitions(F.col("items"), limit), lambda c: F.struct(F.lit("definition").alias("chunk_type"), c["text"].alias("text"), c["terms"].alias("terms")))
    rows = marked.select(doc_col, *names, "page_start", "page_end", "whole", "_terms", short.alias("short"), F.posexplode(F.when(F.col("_first"), by_term).otherwise(other)).alias("chunk_index", "c"))
    whole = F.col("short") & (F.col("c.chunk_type") == "text")
    pages = F.when(whole, F.sequence("page_start", "page_end")).otherwise(chunk_pages(F.col("c.text"), F.col("whole"), F.col("page_start"), F.col("page_end")))
    rows = rows.select(doc_col, *names, F.col("c.chunk_type").alias("chunk_type"), "chunk_index", F.col("c.text").alias("text"), pages.alias("pages"), F.col("c.terms").alias("terms"), F.when(F.col("c.terms").isNull(), F.col("_terms")).alias("_terms"))
    return named_terms(rows.withColumn("chunk_id", _chunk_id(doc_col)).withColumn("n_tokens", word_count(F.col("text"))), doc_col)


def _chunk_id(doc_col: str) -> Column:
    return chunk_id(F.col(doc_col).cast("string"), F.col("section_id"), F.col("chunk_type"), F.col("chunk_index").cast("string"))
