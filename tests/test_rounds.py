"""Two rounds of asking, staged reports, blocks of answers and rollups on small tables."""

import glob
import os
import random

from pyspark.sql import functions as F

from lodestar.operators import asking, blocks, fusion, rollup
from lodestar.plans.answers import echo, steady
from lodestar.sources.report_store import ReportStore


def test_second_round_reads_gated_questions_alone(spark):
    """Question 1 has a good context, 2 a weak one and a concept, 3 a weak one without, 4 a weak one and no sub-query."""
    questions = spark.createDataFrame([(1, "strong covenant"), (2, "weak ratio"), (3, "weak lender"), (4, "weak basket")], "query_id long, query string")
    texts = spark.createDataFrame([(k, "strong covenant ratio") for k in range(10)], "doc_id long, text string")
    seen = []

    def retrieve(asked):
        seen.append(sorted((tuple(r.query_id), r.query) for r in asked.collect()))
        n = F.explode(F.sequence(F.lit(0), F.lit(3)))
        first = F.col("query_id.query_idx") + F.when(F.col("query").startswith("part"), 3).otherwise(0)
        rows = asked.withColumn("n", n).withColumn("doc_id", (first + F.col("n")).cast("long"))
        return rows.select("query_id", "doc_id", F.when(F.col("query").startswith("strong"), 0.9).otherwise(0.1).alias("score"), (F.col("n") + 1).alias("rank"))

    expanded = questions.select("query_id", F.lit(0).alias("query_idx"), "query")
    subs = spark.createDataFrame([(q, i, f"part {i} of {q}") for q in (1, 2, 3) for i in (0, 1)], "query_id long, query_idx int, query string")
    found = asking.two_rounds(questions, expanded, questions.where("query_id <> 3").select("query_id"), subs, retrieve, texts, 3)
    hits = {}
    for r in sorted(found.hits.collect(), key=lambda r: r.pos):
        hits.setdefault(r.query_id, []).append((r.doc_id, r["round"]))
    assert seen[1] == [((2, 0), "part 0 of 2"), ((2, 1), "part 1 of 2")]
    assert hits[1] == hits[3] == hits[4] == [(0, 1), (1, 1), (2, 1)]
    assert hits[2] == [(0, 1), (1, 1), (2, 1), (3, 2), (4, 2), (5, 2)]
    assert {r.query_id: r.decision for r in found.gate.collect()} == {1: "sufficient", 2: "insufficient", 3: "insufficient", 4: "insufficient"}


def test_reports_resume_where_they_stopped(spark, tmp_path):
    rows = [(r, s, f"T{s}", "Borrower: Acme Corp" if s == 1 else f"{{borrower}} owes {s}") for r in (1, 2) for s in range(1, 9)]
    store = ReportStore(spark, f"file://{tmp_path}/reports")
    store.request(spark.createDataFrame(rows, "report_id long, section_number long, title string, prompt string"))
    assert {r.status for r in store.sections().collect()} == {"pending"}
    half = store.resume(echo, F.col("section_number") <= 4).collect()
    assert sum(r.status == "pending" for r in half) == 8
    files = set(glob.glob(f"{tmp_path}/reports/attempts/**/*.parquet", recursive=True))
    times = {f: os.stat(f).st_mtime_ns for f in files}
    done = {(r.report_id, r.section_number): r for r in store.resume(echo).collect()}
    assert done[1, 3].body == "ACME CORP OWES 3" and done[1, 3].attempt == 2 and done[1, 8].attempt == 3
    assert done[2, 7].status == "error" and done[2, 7].error == "no seven"
    again = {(r.report_id, r.section_number): r for r in store.resume(steady).collect()}
    assert again[2, 7].body == "ACME CORP OWES 7" and {k for k in again if again[k] != done[k]} == {(1, 7), (2, 7)}
    fresh = {(r.report_id, r.section_number): r for r in store.regenerate(steady, (F.col("report_id") == 2) & (F.col("section_number") == 5)).collect()}
    assert {k for k in fresh if fresh[k] != again[k]} == {(2, 5)}
    assert all(os.stat(f).st_mtime_ns == t for f, t in times.items())
    assert store.resume(steady).count() == 16


def test_blocks_of_an_answer(spark):
    text = "SUMMARY\nFirst line\nsecond line\n\n- a\n  - b\n  - c\n- d\n1. one\n2. two\n| x | y |\n| --- | --- |\n| 1 | 2 |\nTERM: five years\nNAME: x\n  - alone"
    rows = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "\n\n")], "doc_id long, text string")
    got = [(r.doc_id, r.block, r.kind, r.first_line, r.n_lines, [tuple(x) for x in r["items"]]) for r in blocks.blocks(rows).orderBy("doc_id", "block").collect()]
    assert got == [
        (1, 1, "heading", 0, 1, [("SUMMARY", None)]),
        (1, 2, "paragraph", 1, 2, [("First line", None), ("second line", None)]),
        (1, 3, "list", 4, 4, [("a", None), ("b", 1), ("c", 1), ("d", None)]),
        (1, 4, "numbered", 8, 2, [("one", None), ("two", None)]),
        (1, 5, "table", 10, 3, [("x|y", None), ("1|2", None)]),
        (1, 6, "field", 13, 1, [("TERM: five years", None)]),
        (1, 7, "field", 14, 1, [("NAME: x", None)]),
        (1, 8, "list", 15, 1, [("alone", None)]),
    ]


def test_statistics_merge(spark):
    pages = spark.createDataFrame([(1,), (1,), (2,)], "doc long")
    sections = spark.createDataFrame([(1, "z", ["t"]), (1, "a", None), (1, "a", ["t", "u"]), (1, None, [])], "doc long, section_type string, tables array<string>")
    definitions, chunks = spark.createDataFrame([(1,)], "doc long"), spark.createDataFrame([(1,), (2,), (2,)], "doc long")
    counts = rollup.tagged("doc", pages, sections, definitions, chunks)
    got = {r.doc: r for r in rollup.document_statistics(counts.union(counts)).collect()}
    assert (got[1].page_count, got[1].section_count, got[1].definition_count, got[1].chunk_count, got[1].table_count) == (4, 8, 2, 2, 6)
    assert list(got[1].section_types.items()) == [("a", 4), ("z", 2)]
    assert (got[2].page_count, got[2].section_count, got[2].chunk_count, got[2].section_types) == (2, 0, 4, {})


def test_siblings_by_plain_rules(spark):
    """Sections are opened by their first hit that is no definition; chunks come in order while they fit, and have to share a word."""
    rng = random.Random(6)
    chunks = [(d, f"s{d % 12}", d // 12, rng.choice([0, 90, 150, 260, 400, 900]), rng.choice(["a zebra here", "the QUOKKA", "nothing"])) for d in range(120)]
    asked = [(q, "zebra quokka" if q % 3 else "is it so") for q in range(8)]
    by_id = {c[0]: c for c in chunks}
    hits = [(q, pos, d, by_id[d][1], 1.0 / (pos + 1), rng.random() < 0.3) for q, _ in asked for pos, d in enumerate(rng.sample(range(120), 9))]
    hits += [(0, 20, 500, None, 0.01, False), (1, 20, 501, "elsewhere", 0.01, False)]
    want = {}
    for q, text in asked:
        own, opened, out = {h[2] for h in hits if h[0] == q}, set(), []
        for _, pos, d, section, score, definition in sorted(h for h in hits if h[0] == q):
            if definition or section in opened:
                continue
            opened.add(section)
            left = fusion.SIBLING_TOKENS
            for other in sorted((c for c in chunks if c[1] == section and c[0] not in own), key=lambda c: (c[2], c[0])):
                if (text == "is it so" or "nothing" not in other[4]) and other[3] <= left:
                    left -= other[3]
                    out.append((other[0], section, round(score * fusion.SIBLING_SHARE, 9)))
        want |= {(q, k + 1): x for k, x in enumerate(out)}
    frames = (
        spark.createDataFrame(hits, "query_id int, pos int, doc_id long, section string, score double, definition boolean"),
        spark.createDataFrame(chunks, "doc_id long, section string, chunk_index int, n_tokens int, text string"),
        spark.createDataFrame(asked, "query_id int, query string"),
    )
    got = {(r.query_id, r.pos): (r.doc_id, r.section, round(r.score, 9)) for r in fusion.siblings(*frames).collect()}
    assert got == want and len(want) > 60
    assert fusion.siblings(frames[0].limit(0), *frames[1:]).count() == 0 and fusion.siblings(frames[0], frames[1].limit(0), frames[2]).count() == 0


def test_the_second_round_knows_words_as_its_sql_does(spark, tmp_path):
    """'éque' holds 'que' between ASCII borders, so the question goes into the second round; 'Aquel' doesn't."""
    from lodestar.plans import catalog

    spark.createDataFrame([(1, "éque nada"), (2, "Aquel nada")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "nada de esto", "es", "a")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    asked = catalog.asked_twice(lambda table: spark.read.parquet(f"{tmp_path}/{table}.parquet"))
    assert {r.query_id for r in asked.second.collect()} == {1}
