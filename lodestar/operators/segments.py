"""Segmentation of long documents: page offsets, articles, subsections, definitions, and greedy packing of paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions.answers import once
from lodestar.functions.text import OCR_CHARS, article_number, section_type, strip, word_count

# Header and definition patterns, the delimiter of pages and limits.
ARTICLE = r"(?m)(?:^|\n)\s*ARTICLE\s+([IVXLCDM]+|\d+)\s*[:\-—–.]*\s*\n?\s*([A-Z][A-Za-z0-9 ,&()'/-]+)"
TOP_SECTION = r"(?m)(?:^|\n)\s*SECTION\s+(\d+)\s+([A-Z][A-Z0-9 ,&()'/-]+)"
SUBSECTION = r"(?m)(?:^|\n)\s*(?:SECTION|Section)?\s*(\d+\.\d+)\s*[.:]?\s+([A-Za-z][^\n.;]{2,80})"
DEFINITION = r"(?:\"(?=[^\"”]+\")|“(?=[^\"”]+”))([A-Za-z][A-Za-z0-9\s\-/,()&]+?)[\"”](?=\s*:|\s*(?i:means?|shall\s+mean|has\s+the\s+meaning|is\s+defined\s+as|refers?\s+to))"
PAGE_BREAK, MIN_PREAMBLE, PACK_TOKENS, OVERLAP_TOKENS, SIBLING_TOKENS = "\n\n", 50, 800, 200, 1200
PARAGRAPHS = r"\n\s*\n|\n\s*(?=\([a-z]\)|\([ivx]+\))"
CLAUSES, SENTENCES, MAX_TOKENS = r"(?=\([a-z]\)|\([ivx]+\))", r"(?<=\.)\s+(?=[A-Z])", 1200
CUT = "\x01"


def page_offsets(pages: DataFrame, doc_col: str, page_col: str, text_col: str = "text") -> DataFrame:
    """``offset`` of each page in its document's text, pages joined by a two-character break."""
    before = Window.partitionBy(doc_col).orderBy(page_col).rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("offset", F.coalesce(F.sum(F.length(text_col) + len(PAGE_BREAK)).over(before), F.lit(0)).cast("long"))


def full_texts(pages: DataFrame, doc_col: str, page_col: str, text_col: str = "text") -> DataFrame:
    """(document, text): the pages of each document in order."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(page_col).alias("p"), F.col(text_col).alias("t"))))
    return pages.groupBy(doc_col).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), PAGE_BREAK).alias("text"))


def offset_to_page(points: DataFrame, pages: DataFrame, doc_col: str, page_col: str, point_col: str = "point") -> DataFrame:
    """``page`` of each point: the last page of its document that starts at or before it; 1 if none does. Starts of a document
    stand in one array, so the lookup is an expression and points are joined once."""
    starts = page_offsets(pages, doc_col, page_col).groupBy(doc_col).agg(F.array_sort(F.collect_list(F.struct(F.col("offset"), F.col(page_col).alias("page")))).alias("starts"))
    reached = F.filter("starts", lambda s: s["offset"] <= F.col(point_col))
    return points.join(starts, doc_col, "left").withColumn("page", F.coalesce(F.element_at(reached, -1)["page"], F.lit(1))).drop("starts")


def matches(text: Column, pattern: str) -> Column:
    """Array of (offset from 0, match): the text is cut before each match, and one fold over the parts carries the offset. The text
    must not hold the character that marks cuts; it counts as a blank."""
    parts = F.split(F.regexp_replace(F.replace(text, F.lit(CUT), F.lit(" ")), pattern, CUT + "$0"), CUT)
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<offset:int,part:string>>").alias("out"))
    step = lambda s, p: F.struct((s["at"] + F.length(p)).alias("at"), F.array_append(s["out"], F.struct(s["at"].alias("offset"), p.alias("part"))).alias("out"))
    return F.aggregate(parts, state, step, lambda s: F.slice(s["out"], 2, F.greatest(F.size(s["out"]) - 1, F.lit(0))))


def article_heads(text: Column) -> Column:
    """Array of (start, number, title, end, next) of a text's articles in order: the last header of each article number counts, so a table
    of contents loses. Where a text has no ARTICLE header, SECTION headers with a whole number serve. Number 0 is no article. An article
    ends where the ``next`` starts, the last one with the text."""
    group = lambda m, k: F.coalesce(F.nullif(F.regexp_extract(m["part"], ARTICLE, k), F.lit("")), F.regexp_extract(m["part"], TOP_SECTION, k))
    head = lambda m: F.struct(article_number(group(m, 1)).alias("number"), m["offset"].alias("start"), strip(group(m, 2)).alias("title"))

    def ended(own: Column) -> Column:
        then = lambda i: F.get(own, i + 1)["start"]
        return F.transform(own, lambda x, i: F.struct(x["start"], x["number"], x["title"], F.coalesce(then(i), F.length(text)).alias("end"), then(i).alias("next")))

    def lasts(own: Column) -> Column:
        kept = F.filter(own, lambda x, i: (x["number"] > 0) & ~F.get(own, i + 1)["number"].eqNullSafe(x["number"]))
        return once(F.sort_array(F.transform(kept, lambda x: F.struct(x["start"], x["number"], x["title"]))), ended)

    chosen = once(matches(text, ARTICLE), lambda own: F.when(F.size(own) > 0, own).otherwise(matches(text, TOP_SECTION)))
    return once(F.sort_array(F.transform(chosen, head)), lasts)


def articles(texts: DataFrame, doc_col: str) -> DataFrame:
    """(document, number, title, type, start, end, body) of ``article_heads``."""
    found = texts.select(doc_col, "text", F.explode(article_heads(F.col("text"))).alias("a")).select(doc_col, "text", "a.*")
    return found.select(doc_col, "number", "title", section_type(F.col("title")).alias("type"), "start", "end", F.col("text").substr(F.col("start") + 1, F.col("end") - F.col("start")).alias("body"))


def subsections(found: DataFrame, doc_col: str) -> DataFrame:
    """(document, section_id, title, type, body) of articles: ``n.m`` headers whose first part is the article's number; an article
    without any is one row SECTION_n."""
    heads = found.withColumn("m", F.explode(matches(F.col("body"), SUBSECTION)))
    heads = heads.select(doc_col, "number", F.col("type").alias("kind"), F.col("body").alias("whole"), F.col("m.offset").alias("at"), F.regexp_extract("m.part", SUBSECTION, 1).alias("section_id"), strip(F.regexp_extract("m.part", SUBSECTION, 2)).alias("title"))
    heads = heads.where(F.col("section_id").startswith(F.concat(F.col("number").cast("string"), F.lit("."))))
    end = F.coalesce(F.lead("at").over(Window.partitionBy(doc_col, "number").orderBy("at")), F.length("whole"))
    heads = heads.withColumn("end", end)
    kind = F.nullif(section_type(F.col("title")), F.lit("other"))
    own = heads.select(doc_col, "number", "section_id", "title", F.coalesce(kind, "kind").alias("type"), strip(F.col("whole").substr(F.col("at") + 1, F.col("end") - F.col("at"))).alias("body"))
    alone = found.join(heads.select(doc_col, "number").distinct(), [doc_col, "number"], "left_anti")
    return own.unionByName(alone.select(doc_col, "number", F.concat(F.lit("SECTION_"), F.col("number")).alias("section_id"), "title", "type", strip(F.col("body")).alias("body")))


def preambles(texts: DataFrame, found: DataFrame, doc_col: str) -> DataFrame:
    """(document, text) before the first article, if it is long enough."""
    first = found.groupBy(doc_col).agg(F.min("start").alias("start"))
    text = strip(F.col("text").substr(F.lit(1), F.col("start")))
    return texts.join(first, doc_col).select(doc_col, text.alias("text")).where(F.length("text") >= MIN_PREAMBLE)


def definitions(texts: DataFrame, doc_col: str, with_offset: bool = False, carried: tuple[str, ...] = ()) -> DataFrame:
    """(document, term, body, [at], [carried columns]): quoted terms with a colon or a verb of definition; the first of each term counts, and a body runs from
    the start of the term's line to that of the next term's."""
    text = F.col("text")

    def heads(found: Column) -> Column:
        def head(m: Column, nth: Column) -> Column:
            before = F.get(found, nth - 1)["part"]  # it has the start of the line, unless two terms share one
            near = F.when(F.contains(before, F.lit("\n")), before).otherwise(F.substring(text, F.lit(1), m["offset"]))
            return F.struct(strip(F.regexp_extract(m["part"], DEFINITION, 1)).alias("term"), nth.alias("nth"), (m["offset"] - F.length(F.substring_index(near, "\n", -1))).alias("at"))

        return F.transform(found, head)

    def bodies(own: Column) -> Column:
        stop = lambda i: F.coalesce(F.get(own, i + 1)["at"], F.length(text))
        return F.transform(own, lambda x, i: F.struct(x["term"].alias("term"), strip(text.substr(x["at"] + 1, stop(i) - x["at"])).alias("body"), x["at"].alias("at")))

    def firsts(own: Column) -> Column:
        kept = F.filter(own, lambda x, i: (x["term"] != "") & ((i == 0) | (F.get(own, i - 1)["term"] != x["term"])))
        return once(F.sort_array(F.transform(kept, lambda x: F.struct(x["nth"], x["at"], x["term"]))), bodies)

    # all in the text's own row, so that no text is carried through a shuffle once for each of its terms
    made = once(F.sort_array(once(matches(text, DEFINITION), heads)), firsts)
    return texts.select(doc_col, *carried, F.explode(made).alias("d")).select(doc_col, "d.term", "d.body", *(["d.at"] if with_offset else []), *carried)


def greedy_pack(parts: Column, limit: int = PACK_TOKENS) -> Column:
    """Chunks of an ordered array of texts: as many as fit into ``limit`` words; a longer text stands alone."""
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("held"), F.lit(0).alias("n"))

    def step(s: Column, part: Column) -> Column:
        n = word_count(part)
        fits = s["held"].isNull() | (s["n"] + n <= limit)
        held = F.when(s["held"].isNull(), part).when(fits, F.concat(s["held"], F.lit("\n"), part)).otherwise(part)
        done = F.when(fits, s["done"]).otherwise(F.array_append(s["done"], s["held"]))
        return F.struct(done.alias("done"), held.alias("held"), F.when(fits, s["n"] + n).otherwise(n).alias("n"))

    return F.aggregate(parts, state, step, lambda s: F.when(s["held"].isNull(), s["done"]).otherwise(F.array_append(s["done"], s["held"])))


def tail_within(items: Column, budget: int) -> Column:
    """The longest end of an array of (text, n) whose n add up to at most ``budget``: one fold from the end."""
    state = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def step(s: Column, x: Column) -> Column:
        fits = s["open"] & (s["sum"] + x["n"] <= budget)
        return F.struct(F.when(fits, s["sum"] + x["n"]).otherwise(s["sum"]).alias("sum"), F.when(fits, s["n"] + 1).otherwise(s["n"]).alias("n"), fits.alias("open"))

    n = F.aggregate(F.reverse(items), state, step, lambda s: s["n"])
    return F.slice(items, F.size(items) - n + 1, n)


def split_oversized(paragraph: Column, limit: int = PACK_TOKENS) -> Column:
    """Parts of a long paragraph packed up to ``limit`` words: cut at clause marks, else at semicolons, else at sentences, else whole."""
    clauses, halves, sentences = F.split(paragraph, CLAUSES), F.split(paragraph, ";"), F.split(paragraph, SENTENCES)
    ended = lambda parts: F.transform(parts, lambda p, i: F.when(i < F.size(parts) - 1, F.concat(strip(p), F.lit(";"))).otherwise(strip(p)))
    closed = F.transform(F.array(halves), ended)[0]  # split once, not once a part
    parts = F.when(F.size(clauses) > 1, clauses).when(F.size(halves) > 1, closed).when(F.size(sentences) > 1, sentences).otherwise(F.array(paragraph))
    packed = greedy_pack(F.filter(F.transform(parts, strip), lambda p: p != ""), limit)
    return F.when(F.size(packed) > 0, packed).otherwise(parts)


def overlapping_chunks(text: Column, limit: int = PACK_TOKENS, overlap: int = OVERLAP_TOKENS, most: int = MAX_TOKENS) -> Column:
    """Chunks of whole paragraphs of up to ``limit`` words; each starts with the end of the one before, up to ``overlap`` words: whole
    paragraphs, or sentences of the last one if that is longer. A paragraph of more than ``most`` words that comes when nothing
    is held is cut by itself. Paragraphs end at blank lines or clause marks, else at line ends. The fold carries the words held."""
    filled = lambda parts: F.filter(F.transform(parts, strip), lambda p: p != "")
    wide = filled(F.split(text, PARAGRAPHS))
    counted = F.transform(F.when(F.size(wide) > 1, wide).otherwise(filled(F.split(text, "\n"))), lambda p: F.struct(p.alias("text"), word_count(p).alias("n")))
    kind = "array<struct<text:string,n:int>>"
    state = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast(kind).alias("held"), F.lit(0).alias("n"))
    total = lambda items: F.aggregate(items, F.lit(0), lambda s, x: s + x["n"])
    joined = lambda items: F.array_join(F.transform(items, lambda x: x["text"]), "\n\n")

    def ending(held: Column) -> Column:
        whole = tail_within(held, overlap)
        last = F.transform(F.split(F.element_at(held, -1)["text"], r"(?<=\.)\s+"), lambda t: F.struct(t.alias("text"), word_count(t).alias("n")))
        tail = tail_within(last, overlap)
        sentences = F.array(F.struct(F.array_join(F.transform(tail, lambda x: x["text"]), " ").alias("text"), total(tail).alias("n")))
        return F.when(F.size(whole) > 0, whole).when(F.size(tail) > 0, sentences).otherwise(whole)

    def step(s: Column, p: Column) -> Column:
        empty = F.size(s["held"]) == 0
        alone, full = empty & (p["n"] > most), ~empty & (s["n"] + p["n"] > limit)
        kept = F.when(full, ending(s["held"])).otherwise(s["held"])
        done = F.when(alone, F.concat(s["done"], split_oversized(p["text"], limit))).when(full, F.array_append(s["done"], joined(s["held"]))).otherwise(s["done"])
        held = F.when(alone, s["held"]).otherwise(F.array_append(kept, p))
        n = F.when(alone, s["n"]).when(full, total(kept) + p["n"]).otherwise(s["n"] + p["n"])
        return F.struct(done.alias("done"), held.alias("held"), n.alias("n"))

    return F.aggregate(counted, state, step, lambda s: F.when(F.size(s["held"]) > 0, F.array_append(s["done"], joined(s["held"]))).otherwise(s["done"]))


def within_budget(items: Column, budget: int = SIBLING_TOKENS) -> Column:
    """Keys of an ordered array of (key, n) that fit a budget in order; one that doesn't fit is passed over."""
    state = F.struct(F.array().cast("array<bigint>").alias("taken"), F.lit(budget).alias("left"))

    def step(s: Column, x: Column) -> Column:
        fits = x["n"] <= s["left"]
        return F.struct(F.when(fits, F.array_append(s["taken"], x["key"])).otherwise(s["taken"]).alias("taken"), F.when(fits, s["left"] - x["n"]).otherwise(s["left"]).alias("left"))

    return F.aggregate(items, state, step, lambda s: s["taken"])


def extraction_method(pages: DataFrame, doc_col: str, text_col: str = "text") -> DataFrame:
    """(document, pages, ocr_pages, method): pages with little text need recognition."""
    ocr = F.count_if(F.length(strip(F.col(text_col))) < OCR_CHARS)
    counted = pages.groupBy(doc_col).agg(F.count(F.lit(1)).alias("pages"), ocr.alias("ocr_pages"))
    return counted.withColumn("method", F.when(F.col("ocr_pages") == 0, "digital").when(F.col("ocr_pages") == F.col("pages"), "ocr").otherwise("mixed"))
