"""Text functions on single values, edge cases included."""

import time

import pytest
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators import segments


def one(spark, make, *values):
    frame = spark.createDataFrame([values], ", ".join(f"c{k} string" for k in range(len(values))))
    return frame.select(make(*(F.col(f"c{k}") for k in range(len(values)))).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("make", "given", "want"),
    [
        (T.strip_markdown, "**bold** and `code`\n## Head", "bold and code\nHead"),
        (T.normalize_whitespace, "a \t b\r\n\r\n\r\n\r\nc \n", "a b\n\nc"),
        (T.fix_encoding, "“Café” – naïve—ﬁne•☃", '"Cafe" - naive--fine*'),
        (T.remove_page_artifacts, "text\n- 47 -\nRUNNING HEADER\nmore", "text\nmore"),
        (T.normalize_tables, "intro\n| a | b |\n| 1 | 2 |\noutro", "intro\n\n| a | b |\n| 1 | 2 |\n\noutro"),
        (T.tokenize, 'The "Spread", (4.50x) is $50,000,000.', ["the", "spread", "4.50x", "is", "$50,000,000"]),
        (T.tokenize, " \n", []),
        (T.roman_to_int, "XIV", 14),
        (T.roman_to_int, "MCMXC", 1990),
        (T.article_number, "7", 7),
        (T.article_number, "VII", 7),
        (T.section_type, "Negative Covenants", "negative_covenants"),
        (T.section_type, "Nothing known", "other"),
        (T.confidence, "text\n**Confidence:** medium", "MEDIUM"),
        (T.confidence, "none", "LOW"),
        (T.parse_page_numbers, "45-46, 50, x, 9-7, 45", [45, 46, 50]),
        (T.parse_page_numbers, "", []),
        (T.snippet, "a\nb", "a b"),
        (T.snippet, "x" * 201, "x" * 200 + "..."),
        (T.truncate_definition, "a" * 500 + "." + "b" * 400, "a" * 500 + "."),
        (T.truncate_definition, "a" * 900, "a" * 800 + "..."),
        (T.sub_queries, "1. first query\n- second one\n\nshort\n* third query", ["first query", "second one", "third query"]),
        (T.slug, "My File (v2).pdf", "my-file-v2-pdf"),
        (T.table_cells, "| a | b c |", ["a", "b c"]),
        (T.line_kind, "| a | b |", "table"),
        (T.line_kind, "|---|---|", "separator"),
        (T.line_kind, "PRICING TERMS", "heading"),
        (T.line_kind, "SOFR FLOOR: 1%", "field"),
        (T.line_kind, "- item", "bullet"),
        (T.line_kind, "Plain words.", "paragraph"),
        (T.gate_terms, "What is the Leverage ratio?", ["leverage", "ratio"]),
    ],
)
def test_function(spark, make, given, want):
    assert one(spark, make, given) == want


@pytest.mark.parametrize("make", [T.strip_markdown, T.normalize_whitespace, T.fix_encoding, T.normalize_tables, T.snippet, T.truncate_definition, T.slug])
def test_null_stays_null(spark, make):
    assert one(spark, make, None) is None


def test_page_ranges(spark):
    frame = spark.createDataFrame([([64, 62, 63, 70, 62],), ([],)], "p array<int>")
    assert [r.x for r in frame.select(T.format_page_numbers(F.col("p")).alias("x")).collect()] == ["62-64, 70", ""]


def test_overlap(spark):
    assert one(spark, T.terms_overlap, "what liens apply", "about LIENS") is True
    assert one(spark, T.terms_overlap, "what liens apply", "taxes") is False
    assert one(spark, T.terms_overlap, "is it so", "anything") is True


def test_search_text(spark):
    frame = spark.createDataFrame([(7, "", "7.01", "Liens", "negative_covenants", "body")], "n int, a string, i string, t string, k string, x string")
    got = frame.select(T.search_text(*(F.col(c) for c in frame.columns)).alias("x")).first()["x"]
    assert got == "[Section 7.01: Liens]\n[Type: negative covenants]\nbody"


def test_answers_of_ten_thousand_references(spark):
    """In time that grows with the answer, and without a stack that does."""
    import time

    from lodestar.functions import answers as A

    n = 10_000
    text = "Body " + " ".join(f"[{k}]" for k in range(n, 0, -1)) + "\nReferences:\n" + "\n".join(f"[{k}] Section 7.{k % 90 + 1} (pp. 3, 4)" for k in range(1, n + 1)) + "\n|" + " --- |" * n
    rows = spark.createDataFrame([(text,)], "text string").cache()
    rows.select(A.references(F.lit("References:\n[1] Section 2.1")), A.renumbered(F.lit("a [2]"), F.lit(3))).collect()
    rows.count()
    start = time.time()
    got = rows.select(A.references(F.col("text")).alias("r"), A.answer_body(F.col("text")).alias("b"), A.renumbered(A.answer_body(F.col("text")), F.lit(n)).alias("m"), T.line_kind(F.element_at(F.split("text", "\n"), -1)).alias("k")).first()
    assert time.time() - start < 20
    assert len(got.r) == n and got.r[5].section_id == "7.7" and got.r[5].pages == [3, 4]
    assert got.b.endswith("[2] [1]") and got.m.numbers[:2] == [n, n - 1] and got.m.body.endswith(f"[{n - 1}] [{n}]") and got.k == "separator"


def test_long_texts_take_time_in_proportion(spark):
    """Tables and paragraphs of tens of thousands of parts: arrays are split once."""
    lines = [("| a | b |" if k % 3 else f"line {k}") for k in range(40000)]
    want = [x if k == 0 or x.startswith("|") == lines[k - 1].startswith("|") else "\n" + x for k, x in enumerate(lines)]
    start = time.time()
    assert one(spark, T.normalize_tables, "\n".join(lines)) == "\n".join(want)
    parts = one(spark, segments.split_oversized, ";".join(f"part {k} of it" for k in range(20000)))
    assert time.time() - start < 30 and " ".join(" ".join(parts).split()) == " ".join(f"part {k} of it;" for k in range(20000))[:-1]


def test_quotes_of_definitions_come_in_pairs(spark):
    cases = {"“Term” means x": "Term", '"Term" means x': "Term", '“Term" means x': "", '"Term” means x': "", '"One”, "Two" means': "Two", "“Loan”: x": "Loan"}
    for text, term in cases.items():
        assert one(spark, lambda c: F.regexp_extract(c, segments.DEFINITION, 1), text) == term, text
