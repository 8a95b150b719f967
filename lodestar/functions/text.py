"""Text functions as column expressions; all but fix_encoding stay in the JVM."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

# Marks, words, patterns and limits that results depend on.
WHITE = " \t\n\r\f\v"
EDGE_MARKS = ".,;:!?()[]{}\"'"
OVERLAP_STOP_WORDS = ("that", "this", "with", "from", "have", "been", "were", "shall", "such", "each", "upon", "into", "under", "more", "than", "also")
GATE_STOP_WORDS = (
    "what", "where", "when", "which", "how", "does", "this", "that", "there", "have", "been", "with", "from", "they", "their", "will", "would", "could",
    "should", "about", "into", "than", "then", "also", "just", "more", "some", "such", "only", "very", "most", "document", "agreement", "provision",
    "provisions", "section", "any", "are", "the", "and", "for", "not", "but",
)
ASCII_FORMS = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "--", "•": "*", "ﬁ": "fi", "ﬂ": "fl"}
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
SECTION_TYPE_KEYWORDS = (
    ("financial condition covenant", "financial_covenants"), ("financial covenant", "financial_covenants"), ("financial maintenance", "financial_covenants"),
    ("negative covenant", "negative_covenants"), ("affirmative covenant", "affirmative_covenants"), ("event of default", "events_of_default"),
    ("events of default", "events_of_default"), ("definition", "definitions"), ("defined terms", "definitions"), ("conditions precedent", "conditions"),
    ("condition", "conditions"), ("representation", "representations"), ("warranties", "representations"), ("amount and terms", "facility_terms"),
    ("the credit", "facility_terms"), ("the loan", "facility_terms"), ("amounts and terms", "facility_terms"), ("commitments", "facility_terms"),
    ("letters of credit", "facility_terms"), ("administrative agent", "agents"), ("the agent", "agents"), ("agent", "agents"), ("miscellaneous", "miscellaneous"),
    ("general provisions", "miscellaneous"), ("guaranty", "guaranty"), ("guarantee", "guaranty"), ("collateral", "collateral"), ("security", "collateral"),
    ("pledge", "collateral"), ("exhibit", "exhibits"), ("schedule", "schedules"),
)
CONFIDENCE = r"(?i)(?:^|\n)\s*\*{0,2}Confidence\*{0,2}\s*:\s*\*{0,2}\s*(HIGH|MEDIUM|LOW)\b"
CITATION = r"(?i)Section\s+([\d.]+(?:\([A-Za-z0-9]+\))*)\s*(?:\(pp?\.\s*([\d,\s\-]+)\))?"
MARKER = r"\[(\d+)\]"
SNIPPET_CHARS, DEFINITION_CHARS, OCR_CHARS = 200, 800, 100


def strip(c: Column) -> Column:
    """Without ASCII white space at either end."""
    return F.btrim(c, F.lit(WHITE))


def strip_markdown(c: Column) -> Column:
    """Bold, then headings of one to four marks, then code ticks give way to what they hold."""
    c = F.regexp_replace(c, r"\*\*(.+?)\*\*", "$1")
    c = F.regexp_replace(c, r"(?m)^#{1,4}\s+(.+)$", "$1")
    return F.regexp_replace(c, "`([^`]+)`", "$1")


def normalize_whitespace(c: Column) -> Column:
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


@F.pandas_udf(StringType())
def _decomposed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKD", t), na_action="ignore")


def fix_encoding(c: Column) -> Column:
    """ASCII text: characters are taken apart by compatibility (NFKD), typographic marks become plain ones, the rest goes. Spark has
    no such function, so texts pass Python in Arrow batches."""
    c = _decomposed(c)
    for mark, plain in ASCII_FORMS.items():
        c = F.replace(c, F.lit(mark), F.lit(plain))
    return F.regexp_replace(c, r"[^\x00-\x7F]", "")


def clean_extracted_text(c: Column) -> Column:
    return normalize_whitespace(fix_encoding(c))


def remove_page_artifacts(c: Column) -> Column:
    """Page-number lines and short lines in capitals go."""
    c = F.regexp_replace(c, r"(?m)^\s*-?\s*\d{1,3}\s*-?\s*$", "")
    c = F.regexp_replace(c, r"(?m)^[A-Z\s,&]{5,40}$\n", "")
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def is_table_line(c: Column) -> Column:
    return c.rlike(r"^\s*\|.*\|.*$")


def normalize_tables(c: Column) -> Column:
    """A blank line before and after each block of pipe-table lines."""

    def spaced(lines: Column) -> Column:
        before = lambda i: F.get(lines, i - 1)

        def line(x: Column, i: Column) -> Column:
            turn = (i > 0) & (is_table_line(x) != is_table_line(before(i)))
            blank = F.when(is_table_line(x), strip(before(i)) == "").otherwise(strip(x) == "")
            return F.when(turn & ~blank, F.concat(F.lit("\n"), x)).otherwise(x)

        return F.array_join(F.transform(lines, line), "\n")

    return F.transform(F.array(F.split(c, "\n")), spaced)[0]  # split once, not once a line


def tokenize(c: Column) -> Column:
    """Lower-case words without marks at their edges; amounts and ratios stay whole."""
    words = F.transform(F.split(F.lower(c), r"\s+"), lambda w: F.btrim(w, F.lit(EDGE_MARKS)))
    return F.filter(words, lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def roman_to_int(c: Column) -> Column:
    """Value of a canonical numeral: a letter before a larger one counts negative."""
    value = F.create_map(*[F.lit(x) for pair in ROMAN.items() for x in pair])
    letters = F.filter(F.split(F.upper(c), ""), lambda x: x != "")
    values = F.transform(letters, lambda x: F.coalesce(value[x], F.lit(0)))
    signed = F.transform(values, lambda v, i: F.when(v < F.coalesce(F.get(values, i + 1), F.lit(0)), -v).otherwise(v))
    return F.aggregate(signed, F.lit(0), lambda s, v: s + v)


def article_number(c: Column) -> Column:
    number = F.when(c.rlike("[0-9]"), c.try_cast("int"))  # a cast that fails costs an exception
    return F.coalesce(number, roman_to_int(c))


def section_type(title: Column, fallback: str = "other") -> Column:
    """The type of the first keyword that the title holds."""
    lower = F.lower(title)
    return F.coalesce(*[F.when(F.contains(lower, F.lit(k)), t) for k, t in SECTION_TYPE_KEYWORDS], F.lit(fallback))


def search_text(article_number: Column, article_title: Column, section_id: Column, section_title: Column, kind: Column, text: Column) -> Column:
    """Text with lines of context before it; lines without content are left out."""
    filled = lambda c, out: F.when(F.coalesce(c, F.lit("")) != "", out)
    return F.concat_ws(
        "\n",
        filled(article_title, F.concat(F.lit("[Article "), article_number, F.lit(": "), article_title, F.lit("]"))),
        F.concat(F.lit("[Section "), section_id, F.lit(": "), section_title, F.lit("]")),
        filled(kind, F.concat(F.lit("[Type: "), F.replace(kind, F.lit("_"), F.lit(" ")), F.lit("]"))),
        text,
    )


def chunk_id(*parts: Column) -> Column:
    """Twelve hex digits that depend on the parts alone, so a retried task gives the same id."""
    return F.substring(F.sha2(F.concat_ws("\x01", *parts), 256), 1, 12)


def gate_terms(query: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(query), F.lit("[a-zA-Z]{3,}"), 0), lambda w: ~w.isin(*GATE_STOP_WORDS))


def overlap_words(query: Column) -> Column:
    words = F.transform(F.split(query, r"\s+"), lambda w: F.btrim(w, F.lit(EDGE_MARKS)))
    return F.array_distinct(F.transform(F.filter(words, lambda w: (F.length(w) >= 4) & ~F.lower(w).isin(*OVERLAP_STOP_WORDS)), F.lower))


def terms_overlap(query: Column, text: Column, at_least: int = 1, widen=lambda words: words) -> Column:
    """Whether the text holds enough of the query's words, or of what ``widen`` makes of them; true if the query has none that count."""
    words, lower = widen(overlap_words(query)), F.lower(text)
    return (F.size(words) == 0) | (F.size(F.filter(words, lambda w: F.contains(lower, w))) >= at_least)


def confidence(answer: Column) -> Column:
    return F.coalesce(F.nullif(F.upper(F.regexp_extract(answer, CONFIDENCE, 1)), F.lit("")), F.lit("LOW"))


def parse_page_numbers(c: Column) -> Column:
    """Sorted distinct numbers of lists like '45-46, 50'; parts that are no numbers, and reversed ranges, give none."""
    number = lambda x: strip(x).try_cast("int")

    def pages(part: Column) -> Column:
        first, last = F.substring_index(part, "-", 1), F.substring(part, F.instr(part, "-") + 1, F.length(part))
        low, high = number(first), number(F.when(F.contains(part, F.lit("-")), last).otherwise(first))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(c, ","), lambda p: pages(strip(p))))))


def format_page_numbers(pages: Column) -> Column:
    """Distinct numbers in order, runs as 'first-last'. The sorted array is bound once, so each step looks at two neighbours only."""
    own = F.array(F.array_sort(F.array_distinct(pages)))
    edge = lambda p, next_, by: next_.isNull() | (next_ != p + by)
    starts = F.get(F.transform(own, lambda o: F.filter(o, lambda p, i: edge(p, F.get(o, i - 1), -1))), F.lit(0))
    ends = F.get(F.transform(own, lambda o: F.filter(o, lambda p, i: edge(p, F.get(o, i + 1), 1))), F.lit(0))
    text = F.zip_with(starts, ends, lambda a, b: F.when(a == b, a.cast("string")).otherwise(F.concat_ws("-", a, b)))
    return F.array_join(text, ", ")


def page_runs(rows: DataFrame, key: str, page: str) -> DataFrame:
    """(key, pages) of rows (key, page): ``format_page_numbers`` for keys of very many pages. Runs come from a window, each a row."""
    one = rows.select(key, page).distinct()
    run = F.col(page) - F.row_number().over(Window.partitionBy(key).orderBy(page))
    runs = one.withColumn("_run", run).groupBy(key, "_run").agg(F.min(page).alias("a"), F.max(page).alias("b"))
    text = lambda x: F.when(x["a"] == x["b"], x["a"].cast("string")).otherwise(F.concat_ws("-", x["a"], x["b"]))
    return runs.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", "b"))), text), ", ").alias("pages"))


def snippet(text: Column, chars: int = SNIPPET_CHARS) -> Column:
    head = strip(F.replace(F.substring(text, 1, chars), F.lit("\n"), F.lit(" ")))
    return F.when(F.length(text) > chars, F.concat(head, F.lit("..."))).otherwise(head)


def truncate_definition(text: Column, chars: int = DEFINITION_CHARS) -> Column:
    """At most ``chars``: up to the last period if it lies past the half, else cut hard with dots."""
    head = F.substring(text, 1, chars)
    period = F.length(head) - F.instr(F.reverse(head), ".")
    at_period = F.contains(head, F.lit(".")) & (period > chars // 2)
    return F.when(F.length(text) <= chars, text).when(at_period, head.substr(F.lit(1), (period + 1).cast("int"))).otherwise(F.concat(F.rtrim(head), F.lit("...")))


def sub_queries(text: Column, at_most: int = 5) -> Column:
    lines = F.transform(F.split(strip(text), "\n"), lambda x: strip(F.regexp_replace(x, r"^\s*(?:\d+[.)]\s*|-\s*|\*\s*)", "")))
    return F.slice(F.filter(lines, lambda x: F.length(x) > 5), 1, at_most)


def slug(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))


def table_cells(line: Column) -> Column:
    """Trimmed cells of a pipe-table row."""
    return F.transform(F.split(F.btrim(strip(line), F.lit("|")), r"\|"), strip)


def line_kind(line: Column) -> Column:
    """What a line of an answer is: the first rule that holds."""
    bare = strip(line)
    rules = (
        ("blank", "^$"), ("separator", r"^\|?[ \t:]*-{2,}[ \t:]*(\|[ \t:]*-{2,}[ \t:]*)++\|?$"),
        ("table", r"^\|[^|]+\|.+|^[^|\n]+\|[^|\n]+\||^[^|\n]+[ \t]\|[ \t][^|\n]+"), ("bullet", r"^[-*][ \t]+.+"), ("numbered", r"^[0-9]+\.[ \t]+.+"),
        ("heading", r"^([0-9]+\.[ \t]+)?[A-Z][A-Z0-9 /&,\-()]+([ \t]*\[[0-9, \t]+\])?$"), ("field", r"^[A-Z][A-Z0-9 /&,\-().:]+:[ \t]*.*"),
    )
    return reduce(lambda rest, rule: F.when(bare.rlike(rule[1]), rule[0]).otherwise(rest), reversed(rules), F.lit("paragraph"))


def targeted_snippet(text: Column, words: Column, chars: int = 300) -> Column:
    """A window of the text around the earliest of the words, whatever the case; the text's start if none is there."""
    hits = F.filter(F.transform(words, lambda w: F.position(F.lower(w), F.lower(text))), lambda p: p > 0)
    first = F.greatest(F.lit(0), F.array_min(hits) - 1 - chars // 2)
    end = F.least(F.length(text), first + chars)
    start = F.greatest(F.lit(0), end - chars)
    body = strip(F.replace(text.substr(start + 1, end - start), F.lit("\n"), F.lit(" ")))
    dots = lambda c: F.when(c, F.lit("...")).otherwise(F.lit(""))
    return F.coalesce(F.concat(dots(start > 0), body, dots(end < F.length(text))), snippet(text, chars))


def needs_context(answer: Column) -> Column:
    """(text, follow_up): the answer without its first request for more context, and that request; null if there is none."""
    pattern = r"(?s)\s*<needs_context>(.*?)</needs_context>"
    held = answer.rlike(pattern)
    before = F.regexp_replace(F.split(answer, r"<needs_context>", 2)[0], r"\s+$", "")
    after = F.regexp_replace(answer, r"(?s)^.*?<needs_context>.*?</needs_context>", "")
    text = F.when(held, strip(F.concat(before, after))).otherwise(answer)
    return F.struct(text.alias("text"), F.when(held, strip(F.regexp_extract(answer, pattern, 1))).alias("follow_up"))


def sections_used(ids: Column, shown: int = 3) -> Column:
    """The first distinct ids in order, and how many more there are."""
    own = F.array_distinct(F.filter(ids, lambda x: x.isNotNull() & (x != "")))
    more = F.when(F.size(own) > shown, F.concat(F.lit(" +"), F.size(own) - shown)).otherwise(F.lit(""))
    return F.concat(F.array_join(F.slice(own, 1, shown), ", "), more)
