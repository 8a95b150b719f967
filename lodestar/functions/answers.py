"""Text functions over answers and questions: what is cited, which part is the answer, and how questions are widened."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions.text import CITATION, MARKER, parse_page_numbers, strip, strip_markdown

# Patterns, words and limits that results depend on.
# (The block's lines repeat possessively: the matcher then loops over them and needs no stack.)
SOURCES_LINE = r"(?i)(?:^|\n)\s*\*{0,2}Sources?\*{0,2}\s*:\s*\*{0,2}\s*([^\n]+)"
REFERENCES_BLOCK = r"(?i)(?:^|\n)\s*\*{0,2}References?\*{0,2}\s*:\s*\n\s*\n?((?:\s*\[\d+\]\s*[^\n]+\n?\s*\n?)++)"
REFERENCE_LINE = r"(?i)\[(\d+)\]\s*Section\s+([\d.]+(?:\([A-Za-z0-9]+\))*)\s*(?:\(pp?\.\s*([\d,\s\-]+)\))?(?:\s*--\s*[\"“]([^\n]+?)[\"”])?"
CONFIDENCE_LINE = r"(?i)(?:^|\n)\s*\*{0,2}Confidence\*{0,2}\s*:\s*\*{0,2}\s*(?:HIGH|MEDIUM|LOW)\b"
COMMENTARY = r"(?im)(?:^|\n)\s*COMMENTARY\s*$"
NEARBY_SECTION = r"(?i)Section\s+([\d.]+(?:\([A-Za-z0-9]+\))*)"
KEYWORDS = r"\$[\d,]+(?:\.\d+)?(?:\s*(?:million|billion))?|\d+\.\d+[x%]|\d+(?:\.\d+)?%|[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*"
KEYWORD_CHARS, SECTION_CHARS, MAX_REFORMULATION = 80, 120, 500
PHRASE, ACRONYM = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b", r"\b([A-Z]{2,})\b"
TERM_ALIASES = {
    "applicable margin": "Applicable Margin", "applicable rate": "Applicable Rate", "sofr spread": "Applicable Margin SOFR spread",
    "interest rate": "Applicable Rate interest rate", "pricing grid": "Applicable Rate pricing grid", "base rate": "Alternate Base Rate",
    "abr": "Alternate Base Rate ABR", "commitment fee": "Commitment Fee", "lc fee": "Letter of Credit Fee", "leverage ratio": "Total Net Leverage Ratio",
    "coverage ratio": "Fixed Charge Coverage Ratio", "ebitda": "Consolidated EBITDA", "consolidated ebitda": "Consolidated EBITDA",
    "available amount": "Available Amount", "permitted investments": "Permitted Investments", "permitted liens": "Permitted Liens",
    "permitted indebtedness": "Permitted Indebtedness", "change of control": "Change of Control", "required lenders": "Required Lenders",
    "net income": "Consolidated Net Income", "excess cash flow": "Excess Cash Flow",
}
FINANCIAL_KEYWORDS = (
    "margin", "spread", "rate", "pricing", "interest", "sofr", "libor", "abr", "floor", "grid", "step-down", "step-up", "leverage", "ratio", "covenant",
    "test", "threshold", "basket", "cap", "amount", "limit", "maturity", "amortization", "prepayment", "sweep", "dividend", "distribution",
    "restricted payment", "lien", "collateral", "security", "incremental", "accordion", "facility",
)
LEGAL_SYNONYMS = {
    "spread": ("margin", "rate", "spread", "pricing"), "margin": ("spread", "margin", "rate", "pricing"),
    "rate": ("spread", "margin", "rate", "interest", "pricing"), "covenant": ("covenant", "restriction", "limitation", "prohibition"),
    "lien": ("lien", "security", "encumbrance", "pledge", "collateral"), "debt": ("debt", "indebtedness", "borrowing", "obligation", "loan"),
    "payment": ("payment", "distribution", "dividend", "disbursement"), "basket": ("basket", "exception", "carve-out", "permitted"),
    "facility": ("facility", "commitment", "loan", "credit"), "prepayment": ("prepayment", "repayment", "amortization", "redemption"),
    "investment": ("investment", "acquisition", "purchase"), "default": ("default", "breach", "violation", "event"),
    "maturity": ("maturity", "termination", "expiration"), "leverage": ("leverage", "ratio", "coverage", "test"),
}
QUERY_STOP_WORDS = (
    "what", "which", "where", "when", "that", "this", "these", "those", "about", "with", "from", "have", "does", "will", "would", "could", "should",
    "shall", "being", "been", "were", "some", "more", "most", "also", "only", "than", "then", "into", "over", "under", "such", "each", "every", "other",
    "both", "either", "neither", "between", "through", "during", "before", "after", "there", "their", "your", "tell", "explain", "describe", "section",
    "article",
)
BORROWER, BORROWER_BELOW = r"(?i)BORROWER\s*:\s*([^\n]+?)(?:\n|$)", r"(?i)BORROWER\s*\n+\s*([^\n]+?)(?:\n|$)"
NO_BORROWER = ("NOT FOUND", "NOT IDENTIFIED IN THE PROVIDED CONTEXT")
NOISE = r"(?m)^\s*(?:Powered by BamSEC\.com|PDF page \d+|[A-Z][A-Za-z\s,.]+ / \d+-[A-Z]+ / EX-[\d.]+ / [A-Za-z]+ \d+, \d{4}|\d{1,3}$)\s*$"


def listed_sources(text: Column) -> Column:
    """Array of (section_id, pages) that the first Sources line names, in order."""

    def cited(line: Column) -> Column:
        ids, pages = (F.regexp_extract_all(line, F.lit(CITATION), k) for k in (1, 2))
        return F.zip_with(ids, pages, lambda i, p: F.struct(i.alias("section_id"), _pages(p).alias("pages")))

    return once(F.regexp_extract(text, SOURCES_LINE, 1), cited)


def _pages(c: Column) -> Column:
    return F.coalesce(parse_page_numbers(F.nullif(c, F.lit(""))), F.array().cast("array<int>"))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: what a lambda names from outside is computed again for each element."""
    return F.transform(F.array(value), use)[0]


def references(text: Column) -> Column:
    """Array of (number, section_id, pages, quote) of the References block, by number; the first of each number counts."""

    def rows(block: Column) -> Column:
        number, section, pages, quote = (F.regexp_extract_all(block, F.lit(REFERENCE_LINE), k) for k in (1, 2, 3, 4))
        return F.transform(F.arrays_zip(number.alias("n"), section.alias("s"), pages.alias("p"), quote.alias("q")), lambda x, i: F.struct(x["n"].cast("int").alias("number"), i.alias("at"), x["s"].alias("section_id"), _pages(x["p"]).alias("pages"), strip(x["q"]).alias("quote")))

    found = once(F.regexp_extract(text, REFERENCES_BLOCK, 1), rows)
    first = once(F.array_sort(found), lambda ordered: F.filter(ordered, lambda x, i: (i == 0) | (F.get(ordered, i - 1)["number"] != x["number"])))
    return F.transform(first, lambda x: F.struct(x["number"], x["section_id"], x["pages"], x["quote"]))


def answer_body(text: Column) -> Column:
    """The answer up to its first line of metadata; where there is a commentary, up to the first such line after it."""
    at = lambda c, pattern: once(F.regexp_instr(c, F.lit(pattern)), lambda n: F.when(n > 0, n))

    def body(o: Column) -> Column:
        cut = F.least(*[at(o["rest"], p) for p in (CONFIDENCE_LINE, SOURCES_LINE, REFERENCES_BLOCK)])
        end = once(cut, lambda c: F.when(c.isNull(), F.length(o["text"])).otherwise(o["start"] + c - 2))
        return strip(o["text"].substr(F.lit(1), end))

    def cut_off(o: Column) -> Column:
        return once(F.struct(o["text"].alias("text"), o["start"].alias("start"), o["text"].substr(o["start"], F.length(o["text"])).alias("rest")), body)

    return once(F.struct(text.alias("text"), F.coalesce(at(text, COMMENTARY), F.lit(1)).alias("start")), cut_off)


def plain_body(text: Column) -> Column:
    return strip_markdown(answer_body(text))


def renumbered(body: Column, sources: Column) -> Column:
    """(body, numbers): markers of ``sources`` numbered sources get new numbers by first appearance; ``numbers`` are the old ones in that
    order. Markers that name no source stay."""
    raw = F.regexp_extract_all(body, F.lit(MARKER), 1)
    numbers = F.transform(raw, lambda n: n.try_cast("int"))

    def made(o: Column) -> Column:
        def marker(i: Column) -> Column:
            place = F.array_position(o["order"], F.get(o["numbers"], i))
            return F.when(F.get(o["raw"], i).isNull(), "").otherwise(F.concat(F.lit("["), F.when(place > 0, place.cast("string")).otherwise(F.get(o["raw"], i)), F.lit("]")))

        return F.struct(F.array_join(F.transform(o["parts"], lambda p, i: F.concat(p, marker(i))), "").alias("body"), o["order"].alias("numbers"))

    def ordered(o: Column) -> Column:
        order = F.array_distinct(F.filter(o["numbers"], lambda n: n.between(1, sources)))
        return once(F.struct(o["raw"].alias("raw"), o["numbers"].alias("numbers"), order.alias("order"), F.split(body, r"\[\d+\]").alias("parts")), made)

    return once(F.struct(raw.alias("raw"), numbers.alias("numbers")), ordered)


def marker_windows(body: Column, chars: int) -> Column:
    """Array of (number, window) of all markers in order: up to ``chars`` characters before each."""
    state = F.struct(F.lit("").alias("tail"), F.array().cast("array<struct<number:int,window:string>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        def put(window: Column) -> Column:
            found = F.struct(x["raw"].try_cast("int").alias("number"), window.alias("window"))
            return F.struct(F.concat(window, F.lit("["), x["raw"], F.lit("]")).alias("tail"), F.array_append(s["out"], found).alias("out"))

        return once(F.right(F.concat(s["tail"], x["part"]), F.lit(chars)), put)

    def windows(o: Column) -> Column:
        pieces = F.zip_with(F.slice(o["parts"], 1, F.size(o["raw"])), o["raw"], lambda p, r: F.struct(p.alias("part"), r.alias("raw")))
        return F.aggregate(pieces, state, step, lambda s: s["out"])

    def cut(text: Column) -> Column:
        return once(F.struct(F.split(text, r"\[\d+\]").alias("parts"), F.regexp_extract_all(text, F.lit(MARKER), 1).alias("raw")), windows)

    return once(body, cut)


def keywords(window: Column) -> Column:
    """Amounts, shares, ratios and capitalised phrases."""
    return F.regexp_extract_all(window, F.lit(KEYWORDS), 0)


def section_candidates(section_id: Column) -> Column:
    """The id, then the ids of what it stands in: trailing groups in brackets go one by one."""
    groups = F.size(F.regexp_extract_all(F.regexp_extract(section_id, r"((?:\([A-Za-z0-9]+\))*)$", 1), F.lit(r"\([A-Za-z0-9]+\)"), 0))
    return F.transform(F.sequence(F.lit(0), groups), lambda k: F.regexp_replace(section_id, F.concat(F.lit(r"(?:\([A-Za-z0-9]+\)){"), k, F.lit("}$")), F.lit("")))


def borrower_name(text: Column) -> Column:
    """The name after, or on the line below, BORROWER, without markers and brackets; null if none is given."""
    found = F.coalesce(F.nullif(F.regexp_extract(text, BORROWER, 1), F.lit("")), F.nullif(F.regexp_extract(text, BORROWER_BELOW, 1), F.lit("")))
    name = F.rtrim(strip(found), F.lit("."))
    name = F.rtrim(strip(F.regexp_replace(F.regexp_replace(name, r"\s*\[\d+\]", ""), r"\s*\([^\n]*$", "")), F.lit(",."))
    return F.when((name != "") & ~F.upper(name).isin(*NO_BORROWER), name)


def clean_definition(text: Column) -> Column:
    """Without lines of page headers and numbers, long gaps and runs of blanks."""
    return strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, NOISE, ""), r"\n{3,}", "\n\n"), r"[ \t]+", " "))


def accepted_reformulation(made: Column, question: Column) -> Column:
    """A reformulated question if it is neither empty nor long, else the question."""
    return F.when((F.length(strip(made)) > 0) & (F.length(strip(made)) < MAX_REFORMULATION), strip(made)).otherwise(question)


def baseline_queries(question: Column, at_most: int = 3) -> Column:
    """The question; its capitalised phrases, acronyms and known aliases as a question for definitions; the question with the first
    three financial words it holds, in the order of the list."""
    lower = F.lower(question)
    aliases = F.filter(F.array(*[F.when(F.contains(lower, F.lit(k)), F.lit(v)) for k, v in TERM_ALIASES.items()]), lambda x: x.isNotNull())
    terms = F.concat(F.regexp_extract_all(question, F.lit(PHRASE), 1), F.regexp_extract_all(question, F.lit(ACRONYM), 1), aliases)
    words = F.filter(F.array(*map(F.lit, FINANCIAL_KEYWORDS)), lambda w: F.contains(lower, w))
    asked = F.when(F.size(terms) > 0, F.concat(F.lit("definition "), F.array_join(F.slice(terms, 1, 3), " ")))
    broad = F.when(F.size(words) > 0, F.concat(question, F.lit(" "), F.array_join(F.slice(words, 1, 3), " ")))
    return F.slice(F.filter(F.array(question, asked, broad), lambda x: x.isNotNull()), 1, at_most)


def query_keywords(question: Column) -> Column:
    """Distinct words of four letters or more that aren't in the stop list, in lower case."""
    words = F.transform(F.filter(F.split(question, r"\W+"), lambda w: F.length(w) >= 4), F.lower)
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(*QUERY_STOP_WORDS)))


def with_synonyms(words: Column) -> Column:
    """The words and the synonyms of those, or of their singulars, that have any."""
    known = F.create_map(*[x for k, v in LEGAL_SYNONYMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    singular = lambda w: F.when(w.endswith("s"), w.substr(F.lit(1), F.length(w) - 1))
    more = F.transform(words, lambda w: F.coalesce(F.try_element_at(known, w), F.try_element_at(known, F.coalesce(singular(w), F.lit(""))), F.array().cast("array<string>")))
    return F.array_distinct(F.concat(words, F.flatten(more)))


def normalize_for_search(text: Column) -> Column:
    """Typographic quotes become plain ones, runs of white space one blank."""
    return F.regexp_replace(F.translate(text, "“”‘’", "\"\"''"), r"\s+", " ")


def chunk_pages(chunk: Column, section: Column, first: Column, last: Column) -> Column:
    """Pages that a chunk covers, from its place in the text of its section; all pages if it isn't found or there is one page."""
    pages, whole = last - first + 1, normalize_for_search(section)
    at = F.position(normalize_for_search(F.substring(chunk, 1, 200)), whole) - 1
    size = F.length(whole)
    length = F.floor(F.length(chunk) * size / F.greatest(F.length(section), F.lit(1)))
    start = F.greatest(first, (first + F.floor(at / size * pages)).cast("int"))
    end = F.least(last, (first + F.floor(F.least((at + length) / size, F.lit(1.0)) * pages)).cast("int"))
    every = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    return F.when((pages <= 1) | (F.length(section) == 0) | (at < 0), every).when(start <= end, F.sequence(start, end)).otherwise(F.array().cast("array<int>"))


def joined_list(items: Column) -> Column:
    """A list as one text for stores without arrays; ``split_list`` reads it."""
    return F.array_join(items, "|")


def split_list(text: Column) -> Column:
    return F.filter(F.split(text, r"\|"), lambda x: strip(x) != "")
