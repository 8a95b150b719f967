"""Answers, sections, chunks, prompts and the injection of definitions against plain computations."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from lodestar.functions import answers as A
from lodestar.functions import text as T
from lodestar.operators import chunking, citations, injection, lexical, prompts, segments, vectors
from lodestar.plans import answers, catalog  # noqa: F401  (registers its queries)
from lodestar.sources import store


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text")).alias("x")).first().x


def test_answer_body(spark):
    cases = {
        "Body.\n\n**Confidence:** HIGH\nSources: Section 1.1": "Body.",
        "Body [1]\nReferences:\n[1] Section 2.1\n\nCOMMENTARY\nMore\nConfidence: LOW": "Body [1]\nReferences:\n[1] Section 2.1\n\nCOMMENTARY\nMore",
        "Body [1]\nReferences:\n\n[1] Section 2.1": "Body [1]",
        "No metadata ": "No metadata",
        "": "",
        "Confidence is a word": "Confidence is a word",
    }
    for text, want in cases.items():
        assert one(spark, A.answer_body, text) == want, text
    assert one(spark, A.answer_body, None) is None


def test_sources_and_references(spark):
    text = 'See Section 9.9.\nSources: Section 7.06(a) (pp. 45-46, 50), section 7.07\nSection 8.1\nReferences:\n[2] Section 2.1 (p. 3) -- "two"\n[1] Section 1.1\n[2] Section 5.5'
    assert [(r.section_id, r.pages) for r in one(spark, A.listed_sources, text)] == [("7.06(a)", [45, 46, 50]), ("7.07", [])]
    assert [tuple(r) for r in one(spark, A.references, text)] == [(1, "1.1", [], ""), (2, "2.1", [3], "two")]
    assert one(spark, A.listed_sources, "none") == [] and one(spark, A.references, "none") == []


def test_renumbering_against_substitution(spark):
    rng = random.Random(1)
    for _ in range(25):
        text = "".join(rng.choice(["[1]", "[2]", "[7]", "[12]", "[99999999999]", " a ", "[x]", "\n"]) for _ in range(rng.randrange(12)))
        n = rng.randrange(9)
        order = []
        for m in re.findall(r"\[(\d+)\]", text):
            if 1 <= int(m) <= n and int(m) not in order:
                order.append(int(m))
        want = re.sub(r"\[(\d+)\]", lambda m: f"[{order.index(int(m[1])) + 1}]" if int(m[1]) in order else m[0], text)
        got = one(spark, lambda c, n=n: A.renumbered(c, F.lit(n)), text)
        assert (got.body, got.numbers) == (want, order)
        windows = one(spark, lambda c: A.marker_windows(c, 10), text)
        assert [w.window for w in windows] == [text[max(0, m.start() - 10) : m.start()] for m in re.finditer(r"\[(\d+)\]", text)]


def test_citation_joins(spark):
    chunks = spark.createDataFrame([(1, 0, "7.1", "A", [3], 0.2, "Lien text"), (1, 1, "7.1", "B", [4], 0.9, "Other"), (1, 2, "8", "C", [9], 0.5, "Debt")], "id int, pos int, section_id string, section_title string, pages array<int>, score double, text string")
    cited = spark.createDataFrame([(1, 0, "7.1(a)(ii)", []), (1, 1, "9.9", [1]), (1, 2, "7.1(a)(ii)", [8, 7])], "id int, pos int, section_id string, pages array<int>")
    got = {r.section_id: (r.section_title, r.pages, r.snippet) for r in citations.enriched(cited, chunks, "id").collect()}
    assert got == {"7.1(a)(ii)": ("B", [4, 7, 8], "Other"), "9.9": ("", [1], "")}
    bodies = spark.createDataFrame([(1, "the Lien basket [1] and Section 8(b) here [2] x [3]")], "id int, body string")
    refs = spark.createDataFrame([(1, 1, "7.1(b)", [], ""), (1, 2, "9", [5], "q"), (1, 3, "7.1", [], "own")], "id int, number int, section_id string, pages array<int>, quote string")
    got = {r.number: (r.section_title, r.pages, r.snippet) for r in citations.enriched_inline(refs, chunks, bodies, "id").collect()}
    assert got == {1: ("A", [3], "Lien text"), 2: ("", [5], "q"), 3: ("A", [3], "own")}
    sources = spark.createDataFrame([(1, 0, "7.1"), (1, 1, "8")], "id int, pos int, section_id string")
    assert {r.number: r.section_id for r in citations.from_sources(bodies, sources, "id").collect()} == {1: "7.1", 2: "8", 3: "8"}


def test_fix_encoding_by_decomposition(spark):
    assert one(spark, T.fix_encoding, "½ × Čech … ﬀ x² ™ — “q” ①") == "12  Cech ... ff x2 TM -- \"q\" 1"


def pages_of(spark, texts, tables=None):
    rows = [(d, p, t, (tables or {}).get((d, p), [])) for (d, p), t in texts.items()]
    return spark.createDataFrame(rows, "doc string, page int, text string, tables array<string>")


def test_sections(spark):
    opening = "This credit agreement is made between the borrower and its lenders."
    texts = {
        ("a", 1): opening, ("a", 2): "ARTICLE I\nDEFINITIONS\n1.01 Defined Terms\n\"Loan\" means a loan.\n 12\n\"Lien\": any lien. \"Debt\" means debt",
        ("a", 3): "ARTICLE II\nNEGATIVE COVENANTS\n2.01 Liens\nNo liens at all", ("a", 4): "more of liens\n2.02 Events of Default\nNone", ("a", 5): "the end",
        ("b", 1): "Nothing is here", ("b", 2): "at all", ("c", 1): "SECTION 1 THE LOANS\nText of it", ("c", 2): "ARTICLE 3\nAGENTS\nbody",
    }
    rows = chunking.sections(pages_of(spark, texts, {("a", 4): ["t4"], ("a", 5): ["t5"], ("b", 2): ["tb"]}), "doc").orderBy("doc", "ord").collect()
    got = [(r.doc, r.section_id, r.section_type, r.page_start, r.page_end, r.tables) for r in rows]
    assert got == [
        ("a", "PREAMBLE", "preamble", 1, 1, []), ("a", "1.01", "definitions", 2, 2, []), ("a", "2.01", "negative_covenants", 3, 4, []),
        ("a", "2.02", "events_of_default", 4, 5, ["t4", "t5"]), ("b", "FULL_DOC", "other", 1, 2, ["tb"]), ("c", "SECTION_3", "agents", 1, 2, []),
    ]
    pages = pages_of(spark, texts)
    defined = chunking.definitions(chunking.sections(pages, "doc"), pages, "doc").orderBy("ord").collect()
    assert [(r.term, r.text, r.page) for r in defined if r.doc == "a"][0] == ("Loan", '"Loan" means a loan.', 2)
    assert {r.term for r in defined} == {"Loan", "Lien", "Debt"}
    empty = pages.limit(0)
    assert chunking.sections(empty, "doc").count() == 0


def test_top_sections_stand_in_for_articles(spark):
    rows = chunking.sections(pages_of(spark, {("c", 1): "SECTION 1 THE LOANS\nText of it\nSECTION 2 AGENTS\nmore"}), "doc").orderBy("ord").collect()
    assert [(r.section_id, r.section_type) for r in rows] == [("SECTION_1", "facility_terms"), ("SECTION_2", "agents")]


def test_pack_definitions(spark):
    rng = random.Random(3)
    for _ in range(15):
        items = [(f"t{k}", f"text {k}", rng.choice([1, 5, 20, 30, 49, 50, 90])) for k in range(rng.randrange(12))]
        want, held, n = [], [], 0
        for term, text, size in items:
            if size >= 50 or (held and n + size > 60):
                want += [held] if held else []
                held, n = [], 0
            if size >= 50:
                want.append([(term, text)])
            else:
                held.append((term, text))
                n += size
        want += [held] if held else []
        frame = spark.createDataFrame([(items,)], "x array<struct<term:string,text:string,n:int>>")
        got = frame.select(chunking.pack_definitions(F.col("x"), 60).alias("x")).first().x
        assert [(c.text, c.terms) for c in got] == [("\n\n".join(t for _, t in c), [t for t, _ in c]) for c in want]


def test_chunk_pages_and_oversized(spark):
    frame = spark.createDataFrame([("a" * 500 + "b" * 500, "b" * 300, 3, 6), ("abc", "x", 3, 6), ("abc", "a", 2, 2), ("", "a", 2, 4)], "s string, c string, a int, b int")
    got = [r.x for r in frame.select(A.chunk_pages(F.col("c"), F.col("s"), F.col("a"), F.col("b")).alias("x")).collect()]
    assert got == [[5, 6], [3, 4, 5, 6], [2], [2, 3, 4]]
    long = "(a) " + "one " * 5 + "(b) " + "two " * 5
    assert one(spark, lambda c: segments.split_oversized(c, 7), long) == [("(a) " + "one " * 5).strip(), ("(b) " + "two " * 5).strip()]
    assert one(spark, lambda c: segments.split_oversized(c, 4), "a b c; d e; f") == ["a b c;", "d e;\nf"]
    assert one(spark, lambda c: segments.split_oversized(c, 3), "A b c. D e f. G") == ["A b c.", "D e f.", "G"]
    assert one(spark, lambda c: segments.split_oversized(c, 3), "a b c d e") == ["a b c d e"]
    assert one(spark, lambda c: segments.overlapping_chunks(c, 4, 1, 6), "a b c d e f g; h\n\nx y") == ["a b c d e f g;", "h", "x y"]


def test_injected_terms_by_plain_rules(spark):
    """Scores, tiers and slots against a direct computation over random agreements."""
    rng = random.Random(8)
    names = [f"{a} {b}" for a in ("Alpha", "Gamma", "Delta", "Sigma", "Omega", "Theta") for b in ("Margin", "Basket", "Ratio", "Notice")]
    defined = {n: f"{n} text " + " ".join(rng.sample(names, rng.randrange(3))) + " x" * rng.choice([1, 500]) for n in names}
    chunk = {k: rng.sample(names, rng.randrange(1, 7)) for k in range(12)}
    asked = {q: f"describe the {rng.choice(names)} with some basket" for q in range(4)}
    hit = {q: rng.sample(sorted(chunk), 5) for q in asked}
    common, with_chunk = set(rng.sample(names, 3)), set(rng.sample(names, 9))
    d = spark.createDataFrame([("d", k, n, t) for k, (n, t) in enumerate(defined.items())], "doc string, ord int, term string, text string")
    hits = spark.createDataFrame([(q, "d", f"c{c}", chunk[c]) for q in hit for c in hit[q]], "query_id int, doc string, chunk_id string, terms array<string>")
    chunk_terms = spark.createDataFrame([("d", f"c{c}", t) for c in chunk for t in chunk[c]], "doc string, chunk_id string, term string")
    flag = lambda s: spark.createDataFrame([("d", x) for x in s], "doc string, term string")
    questions = spark.createDataFrame([(q, "d", t) for q, t in asked.items()], "query_id int, doc string, query string")
    scored = injection.candidate_terms(questions, hits, chunk_terms, d, flag(with_chunk), flag(common), "doc")
    refs = {n: {m for m in names if m in t} for n, t in defined.items()}
    references = spark.createDataFrame([("d", n, m) for n in refs for m in refs[n]], "doc string, term string, ref string")
    got = {}
    for r in injection.injected_terms(scored, references, "doc", 6, 3).collect():
        got.setdefault(r.query_id, {}).setdefault(r.tier, []).append((r.rank, r.term))
    for q, text in asked.items():
        n = Counter(t for c in hit[q] for t in chunk[c])
        inside = {x for x in names if x in text}
        words = {w for w in re.split(r"\W+", text.lower()) if len(w) >= 4} - set(A.QUERY_STOP_WORDS)
        keyed = {x for x in names if any(w in x.lower() for w in words)}
        score = {}
        for t in set(n) | inside | keyed:
            s = math.log2(n[t] + 1) if n[t] else 0
            s += 100 if t in inside else -50 if t in common else 0
            s += 3 if t in n and t not in common else 0
            s += 10 if t in keyed and t not in inside else 0
            s += 15 if len(defined[t]) > 800 and t in with_chunk and t not in common and n[t] else 0
            score[t] = round(s, 6)
        order = lambda of, by: sorted(of, key=lambda t: (-by[t], -len(t), t))
        primary = order(score, score)[:6]
        rest = order([t for t in n if t not in primary and t not in common], score)
        times = Counter(m for p in [*primary, *rest] for m in refs[p] if m not in primary) + Counter(rest)
        slots = max(6 - len(primary), 3)
        first = rest[:slots]
        second = order([t for t in times if t not in first], times)[: slots - len(first)]
        want = {0: primary, 1: first, 2: second}
        assert {k: [t for _, t in sorted(v)] for k, v in got[q].items()} == {k: v for k, v in want.items() if v}


def test_injection_and_promotion(spark):
    d = spark.createDataFrame([("d", 0, "Long", "x" * 900), ("d", 1, "Short", "y"), ("d", 2, "Common", "z"), ("d", 3, "There", "w" * 900)], "doc string, ord int, term string, text string")
    terms = spark.createDataFrame([(1, "d", t, False) for t in ("Long", "Short", "Common", "There", "Missing")], "query_id int, doc string, term string, in_query boolean")
    with_chunk = spark.createDataFrame([("d", "Long", "c1"), ("d", "There", "c2")], "doc string, term string, chunk_id string")
    hits = spark.createDataFrame([(1, "c2")], "query_id int, chunk_id string")
    common = spark.createDataFrame([("d", "Common")], "doc string, term string")
    injected, promoted = injection.injected_or_promoted(terms, d, with_chunk, common, hits, "doc")
    assert [r.term for r in injected.collect()] == ["Short"] and [(r.term, r.chunk_id) for r in promoted.collect()] == [("Long", "c1")]
    held = spark.createDataFrame([(1, 1, "a", "s", 0.9, False), (1, 2, "b", "s", 0.1, False), (1, 3, "c", "s", 0.05, True)], "query_id int, pos int, doc_id string, section string, score double, definition boolean")
    more = spark.createDataFrame([(1, 1, "p", "s")], "query_id int, pos int, doc_id string, section string")
    assert [(r.doc_id, round(r.score, 4)) for r in injection.promote(held, more, 3).orderBy("pos").collect()] == [("a", 0.9), ("p", 0.095), ("c", 0.05)]


def test_prompt_parts(spark):
    hits = spark.createDataFrame([(1, 1, "x", "7.1", "Liens", [4, 3, 7], "lien text", 0.9)], "query_id int, pos int, doc_id string, section_id string, section_title string, pages array<int>, text string, score double")
    asked = spark.createDataFrame([(1, "why?"), (2, "how?")], "query_id int, question string")
    opening = spark.createDataFrame([(1, [1, 2], " Opening "), (2, None, "  ")], "query_id int, pages array<int>, text string")
    defined = spark.createDataFrame([(1, 1, "Lien", "lien text"), (1, 2, "Debt", "a debt")], "query_id int, pos int, term string, text string")
    history = spark.createDataFrame([(1, k, f"q{k}", f"a{k}") for k in range(5)], "query_id int, turn int, question string, answer string")
    fresh = prompts.new_definitions(defined, hits)
    got = {r.query_id: r.prompt for r in prompts.contexts(asked, prompts.numbered_sources(hits, opening), fresh, None, history).collect()}
    assert got[1] == (
        "=== CONTEXT FROM CREDIT AGREEMENT ===\n\n[Source 1] Preamble and Recitals (pp. 1-2)\nOpening\n\n[Source 2] Liens (Section 7.1, pp. 3-4, 7)\nlien text\n"
        '\n\n=== RELEVANT DEFINITIONS ===\n"Debt" means a debt\n\n=== PREVIOUS Q&A IN THIS SESSION ===\nUser: q2\nAssistant: a2\nUser: q3\nAssistant: a3\nUser: q4\nAssistant: a4\n\n=== CURRENT QUESTION ===\nwhy?'
    )
    assert got[2] == "=== CONTEXT FROM CREDIT AGREEMENT ===\n\n\n=== CURRENT QUESTION ===\nhow?"


def test_stored_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "lien lien basket"), (2, "margin"), (3, None), (4, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(9, "Lien, margin?")], "query_id long, query string")
    index = lexical.index(docs).write(str(tmp_path))
    rows = lambda of: sorted((r.doc_id, round(r.score, 12)) for r in lexical.scores(asked, of).collect())
    assert rows(index) == rows(docs) == rows(lexical.read_index(spark, str(tmp_path)))


def test_nearest_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERIES", 7)
    monkeypatch.setattr(vectors, "VECTORS", 11)
    rng = random.Random(2)
    rows = [(k, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(4)], k % 3) for k in range(80)] + [(90, None, 0), (91, [1.0] * 4, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    q = v.where("vec_id % 4 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "label")
    got = {}
    for r in vectors.nearest(q, v, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    fine = [(i, x, lab) for i, x, lab in rows if x and any(x) and lab is not None]
    for i, x, lab in fine:
        if i % 4 == 0:
            cos = lambda y, x=x: sum(a * b for a, b in zip(x, y, strict=True)) / math.sqrt(sum(a * a for a in x) * sum(b * b for b in y))
            want = sorted((-round((1 + cos(y)) / 2, 11), j) for j, y, other in fine if other == lab)[:5]
            assert [j for j, _ in got[i]] == [j for _, j in want]


def test_sections_cut_a_body_in_its_article_row(spark):
    """No window carries the text of an article: the plan keeps those of page offsets and of the order of sections."""
    from lodestar.operators import chunking

    text = "ARTICLE I\nNEGATIVE COVENANTS\n1.01 Liens\nNone but one.\n9.01 Other\nNo head here.\n1.02 Debt\nNone."
    pages = spark.createDataFrame([("d", 1, text, ["t"])], "doc string, page int, text string, tables array<string>")
    made = chunking.sections(pages, "doc")
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Window [") <= 2
    rows = [(r.ord, r.section_id, r.text.strip().split("\n")[-1]) for r in made.orderBy("ord").collect()]
    assert rows == [(1, "1.01", "No head here."), (2, "1.02", "None.")]


def test_parts_of_answers_are_found_once(spark):
    """Patterns are not matched again for each use of what they find, and citations meet their chunks by shuffles of lines by id alone."""
    text = spark.createDataFrame([("Body [1].\n\nConfidence: HIGH",)], "text string")
    body = text.select(A.answer_body(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert body.count("(?:HIGH|MEDIUM|LOW)") <= 2  # five times before
    refs = text.select(A.references(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert refs.count("References?") <= 2
    for name in ("inline_citations", "enriched_citations", "marker_keywords"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == {"marker_keywords": 1, "inline_citations": 3, "enriched_citations": 2}[name]


def test_stored_tables_are_not_broadcast_in_joins(spark):
    """They are small as files and large in memory, so the driver must not hold them."""
    a = store.written(spark.range(9).withColumn("x", F.lit("a")), "a")
    b = store.written(spark.range(5), "b").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    assert "Broadcast" not in a.join(b, "id", "left")._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.n or 0 for r in a.join(b, "id", "left").collect()) == [0] * 4 + [1] * 5


def test_definitions_stay_in_their_text(spark):
    """No text is carried through a shuffle for each of its terms; the first of a term counts."""
    text = 'Terms\n"Lien" means a.\nmore\n"Debt" means b.\n"Lien" means c.\n'
    found = segments.definitions(spark.createDataFrame([(1, text), (2, None), (3, "none")], "doc int, text string"), "doc", with_offset=True)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r.doc, r.term, r.body, r.at) for r in found.collect()] == [(1, "Lien", '"Lien" means a.\nmore', 6), (1, "Debt", '"Debt" means b.\n"Lien" means c.', 27)]


def test_agreements_shuffle_each_table_once(spark):
    """Pages meet once for sections; sections and definitions meet once for chunks, and no row is made for a term."""
    pages = pages_of(spark, {("a", 1): 'ARTICLE I\nDEFINITIONS\n1.01 Defined Terms\n"Loan" means a loan', ("a", 2): "ARTICLE II\nAGENTS\n2.01 Agents\nThe Loan"})
    shuffles = lambda frame: frame._jdf.queryExecution().sparkPlan().toString().count("Exchange") + frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning")
    made = chunking.sections(pages, "doc")
    assert shuffles(made) == 1
    found = store.written(made, "sections")
    defined = store.written(chunking.definitions(found, pages, "doc"), "definitions")
    chunks = chunking.chunks(found, defined, "doc")
    assert shuffles(chunks) == 2
    assert sorted((r.section_id, r.chunk_type, r.terms) for r in chunks.collect()) == [("1.01", "definition", ["Loan"]), ("2.01", "text", ["Loan"])]


def test_chunks_have_the_terms_of_their_own_text(spark):
    """Two sections of one number share a chunk id, but each names the terms of its text; a document without definitions names none."""
    pages = pages_of(spark, {("a", 1): 'ARTICLE I\nDEFINITIONS\n1.01 Defined Terms\n"Loan" means a loan\n"Term Loan" means a Loan', ("a", 2): "ARTICLE II\nAGENTS\n2.01 Agents\nA Term Loan\n2.01 Agents\nnone", ("b", 1): "ARTICLE II\nAGENTS\n2.01 Agents\nA Loan"})
    found = store.written(chunking.sections(pages, "doc"), "sections")
    rows = chunking.chunks(found, store.written(chunking.definitions(found, pages, "doc"), "definitions"), "doc").where("chunk_type = 'text'").collect()
    assert sorted((r.doc, r.text, r.terms) for r in rows) == [("a", "2.01 Agents\nA Term Loan", ["Term Loan", "Loan"]), ("a", "2.01 Agents\nnone", []), ("b", "2.01 Agents\nA Loan", [])]


def test_terms_that_share_a_line(spark):
    text = 'x\n"Lien" means a lien, "Debt" means debt\n  "Loan": any\n"Lien" means more'
    found = segments.definitions(spark.createDataFrame([(1, text, 7)], "doc int, text string, kept int"), "doc", with_offset=True, carried=("kept",)).collect()
    assert sorted((r.term, r.at, r.kept) for r in found) == [("Debt", 2, 7), ("Lien", 2, 7), ("Loan", 41, 7)]


def test_sources_of_markers_need_one_shuffle_of_each_table(spark):
    bodies = spark.createDataFrame([(1, "Section 7.1(a)(ii) x [1] [2] [9] [99999999999] [1]"), (2, "Section 5 x [1]"), (3, None), (None, "Section 8 [1]")], "id int, body string")
    sources = spark.createDataFrame([(1, 0, "7.1"), (1, 1, "8"), (1, 2, None), (2, 0, "9"), (None, 0, "8"), (1, 3, "7.1")], "id int, pos int, section_id string")
    found = citations.from_sources(bodies, sources, "id")
    assert found._jdf.queryExecution().sparkPlan().toString().count("Join") == 1
    assert sorted((r.id, r.number, r.section_id) for r in found.collect()) == [(1, 1, "7.1"), (1, 2, "7.1"), (1, 9, "7.1"), (2, 1, "9")]
