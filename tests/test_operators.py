"""Operators on small tables, and all registered queries against DuckDB."""

import math
import os
import random
import re

import duckdb
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

import __spark_entry__
from lodestar.operators import citations, dialogue, fusion, knowledge, lexical, segments, terms, vectors
from lodestar.plans import catalog
from lodestar.sources.store import ChunkStore, markdown_table
from lodestar.streaming import ingest

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    return repr(round(x, 9)) if isinstance(x, float) else str(x)


NAMES = sorted(n for n in __spark_entry__.oracle_sql() if n in catalog.QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_twin(spark, name):
    frame = catalog.QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    twin = con.sql(catalog.ORACLE_SQL[name])
    at = [twin.columns.index(c) for c in columns]
    assert sorted(twin.columns) == columns
    assert got == sorted(tuple(plain(r[k]) for k in at) for r in twin.fetchall())


def test_sums_of_scores_do_not_depend_on_their_order(spark):
    """Ranks of equal texts hang on the last digits, which plain sums change with the order of rows."""
    rng = random.Random(3)
    values = [rng.uniform(0, 12) for _ in range(150)]
    rows = [(k, x) for k in range(40) for x in rng.sample(values, len(values))]
    frame = spark.createDataFrame(rows, "k long, x double").coalesce(1)
    got = frame.groupBy("k").agg(lexical.steady_sum(F.col("x")).alias("steady"), F.sum("x").alias("plain")).collect()
    assert len({r.plain for r in got}) > 1
    assert {r.steady for r in got} == {math.fsum(values)}


def test_documents_of_other_sections_are_not_scored(spark):
    """Scores are the corpus', but only the documents that are listed are joined with the questions."""
    docs = spark.createDataFrame([(1, "lien basket", "a"), (2, "lien margin", "b"), (3, "margin", "a")], "doc_id long, text string, section_type string")
    asked = spark.createDataFrame([(9, "lien margin")], "query_id long, query string")
    cut = lexical.scores(asked, docs, only=lexical.sections_of(docs, "a"))
    whole = {r.doc_id: r.score for r in lexical.in_sections(lexical.scores(asked, docs), docs, "a").collect()}
    assert {r.doc_id: r.score for r in cut.collect()} == whole and sorted(whole) == [1, 3]


def test_best_equals_ranked_scores(spark, monkeypatch):
    """Blocks of queries and documents give the ranks of all scores: ties of equal texts, repeated ids, ids of another type, filters."""
    monkeypatch.setattr(lexical, "QUERIES", 3)
    monkeypatch.setattr(lexical, "DOCS", 5)
    words = "lien margin term rate agent lender fee notice".split()
    texts = [" ".join(words[(n * m + m) % 8] for m in range(1, 3 + n % 6)) for n in range(40)] + ["lien margin fee"] * 20 + ["", None]
    docs = spark.createDataFrame([(f"d{n % 57:02d}", t) for n, t in enumerate(texts)], "doc_id string, text string")
    asked = spark.createDataFrame([(q, " ".join(words[q % 8 :] + words[: q % 3])) for q in range(11)] + [(99, "absent"), (100, None)], "query_id long, query string")
    rows = lambda frame: sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in frame.collect())
    only = docs.where("doc_id < 'd30'").select("doc_id")
    for of, cut in ((docs, None), (docs, only), (lexical.index(docs), None)):
        want = rows(lexical.top_k(lexical.scores(asked, of, only=cut), 4))
        assert want and rows(lexical.best(asked, of, 4, only=cut)) == want


def test_block_gives_few_rows_of_many_equal_scores():
    n = 500
    docs = pa.table({"id": pa.array(range(n, 0, -1), pa.int64()), "token": ["lien"] * n, "weight": [1.5] * n})
    got = lexical.best_of_block(docs, pa.table({"query_id": [7], "token": ["lien"], "w": [2.0]}), 10)
    assert sorted(got["id"].to_pylist()) == list(range(1, 11)) and set(got["score"].to_pylist()) == {5.0}


def test_block_takes_pairs_as_ids_of_queries():
    kind = pa.struct([pa.field("query_id", pa.int64()), pa.field("query_idx", pa.int32(), nullable=False)])
    pair = lambda a, b: {"query_id": a, "query_idx": b}
    asked = pa.table({"query_id": pa.array([pair(1, 0), pair(1, 1), pair(1, 0)], kind), "token": ["a", "a", "b"], "w": [1.0, 2.0, 3.0]})
    got = lexical.best_of_block(pa.table({"id": [5, 6], "token": ["a", "b"], "weight": [1.0, 1.0]}), asked, 1)
    assert got.to_pylist() == [{"query_id": pair(1, 0), "id": 6, "score": 7.0}, {"query_id": pair(1, 1), "id": 5, "score": 4.0}]


def test_search_makes_no_row_for_each_shared_token(spark, tmp_path):
    """Each of 60 queries shares its tokens with each of 300 documents; no step may make a row for each such pair."""
    spark.createDataFrame([(n, f"lien margin rate w{n}", "en", "src0") for n in range(300)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(n, "lien margin rate lien margin rate") for n in range(60)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = catalog.QUERIES["multi_query_search"](spark, f"file://{tmp_path}")
    assert out.count() == 60 * 10
    out.collect()
    plan, made = [out._jdf.queryExecution().executedPlan()], []
    while plan:
        node = plan.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            plan.append(node.executedPlan())
        elif hasattr(node, "plan") and "QueryStage" in node.getClass().getSimpleName():
            plan.append(node.plan())
        children = node.children()
        plan += [children.apply(k) for k in range(children.size())]
        metric = node.metrics().get("numOutputRows")
        made += [metric.get().value()] if metric.isDefined() else []
    assert made and max(made) < 60 * 300


def test_bm25_formula(spark):
    docs = spark.createDataFrame([(1, "lien lien basket"), (2, "margin"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in lexical.scores(spark.createDataFrame([(9, "Lien, margin?")], "query_id long, query string"), docs).collect()}
    idf, avgdl = math.log(5 / 1), 4 / 4
    tf = lambda n, dl: n * 2.2 / (1.2 * (0.5 + 0.5 * dl / avgdl) + n)
    assert got == pytest.approx({1: 2 * idf + idf * tf(2, 3), 2: 2 * idf + idf * tf(1, 1)})
    assert lexical.scores(spark.createDataFrame([(9, "absent")], "query_id long, query string"), docs).count() == 0


def test_nearest_ties_and_labels(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [0.0, 1.0], 1), (4, [-1.0, 0.0], 0)], "vec_id long, embedding array<float>, label int")
    q = v.where("vec_id = 2").select(F.lit(5).alias("query_id"), F.col("embedding").alias("vector"))
    got = [(r.vec_id, r.score) for r in vectors.nearest(q, v, 4).orderBy("rank").collect()]
    assert got == [(1, 1.0), (2, 1.0), (3, 0.5), (4, 0.0)]


def test_score_floor(spark):
    hits = [(1, p, s, "text") for p, s in ((1, 0.5), (2, 0.1), (3, 0.01), (4, 0.2))] + [(2, 1, 0.0, "text"), (2, 2, 0.0, "text")] + [(3, p, 0.9 - p / 10, "definition" if p > 7 else "text") for p in range(1, 10)]
    got = sorted((r.query_id, r.pos) for r in fusion.score_floor(spark.createDataFrame(hits, "query_id int, pos int, score double, chunk_type string")).collect())
    assert got == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), *[(3, p) for p in range(1, 10)]]


def test_segments(spark):
    body = "Preamble of the agreement dated today between a borrower and its lenders.\nARTICLE I\nDEFINITIONS\nSome text.\nARTICLE VII - NEGATIVE COVENANTS\nSection 7.01 Liens. None.\nSection 7.02 Debt\nNo debt over $5.\n9.01 Elsewhere here\n"
    toc = "ARTICLE I DEFINITIONS\nARTICLE VII NEGATIVE COVENANTS\n"
    texts = spark.createDataFrame([("d", body), ("toc", toc + body), ("plain", "no headers here")], "doc string, text string")
    found = segments.articles(texts, "doc")
    got = {(r.doc, r.number): r for r in found.collect()}
    assert set(got) == {(d, n) for d in ("d", "toc") for n in (1, 7)}
    assert got["d", 7].type == "negative_covenants" and got["d", 1].type == "definitions" and "Some text" in got["toc", 1].body
    subs = sorted((r.doc, r.section_id) for r in segments.subsections(found, "doc").collect())
    assert subs == [("d", "7.01"), ("d", "7.02"), ("d", "SECTION_1"), ("toc", "7.01"), ("toc", "7.02"), ("toc", "SECTION_1")]
    assert [r.doc for r in segments.preambles(texts, found, "doc").collect() if r.text.startswith("Preamble")] == ["d"]


def test_definitions(spark):
    text = 'Intro\n"Applicable Rate" means the rate.\nmore of it\n“Basket”: an amount.\n"Other" is only quoted.\n"Basket": again.'
    got = {r.term: r.body for r in segments.definitions(spark.createDataFrame([(1, text)], "doc int, text string"), "doc").collect()}
    assert set(got) == {"Applicable Rate", "Basket"} and got["Applicable Rate"].endswith("more of it") and got["Basket"].startswith("“Basket”")


def test_packing_and_budget(spark):
    frame = spark.createDataFrame([(["a b", "c d", "e f g h i j", "k"],), ([],)], "p array<string>")
    assert [r.x for r in frame.select(segments.greedy_pack(F.col("p"), 5).alias("x")).collect()] == [["a b\nc d", "e f g h i j", "k"], []]
    items = spark.createDataFrame([([(1, 3), (2, 9), (3, 2)],)], "i array<struct<key:long,n:int>>")
    assert items.select(segments.within_budget(F.col("i"), 5).alias("x")).first().x == [1, 3]


def test_citations(spark):
    answers = spark.createDataFrame([(1, "As [3] says, and [1], [3], [9]. Section 7.06(a) (pp. 45-46), Section 7.06(a) (p. 50)")], "id int, text string")
    sources = spark.createDataFrame([(1, 1, "a"), (1, 3, "c")], "id int, number int, source string")
    assert sorted((r.number, r.new_number) for r in citations.renumber(answers, sources, "id").collect()) == [(1, 2), (3, 1)]
    assert [(r.section_id, r.pages) for r in citations.cited_sources(answers, "id").collect()] == [("7.06(a)", "45-46, 50")]
    parents = citations.with_parents(spark.createDataFrame([("7.06(a)(ii)",)], "section_id string")).orderBy("depth").collect()
    assert [r.candidate for r in parents] == ["7.06(a)(ii)", "7.06(a)", "7.06"]


def test_dialogue(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "q1"), (1, 2, "assistant", ""), (1, 3, "user", "q2"), (1, 4, "assistant", "a2" * 500), (1, 5, "assistant", "late")]
    history = dialogue.pairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = dialogue.recent(history).collect()
    assert [(r.turn, r.question, len(r.answer)) for r in got] == [(3, "q2", 803)]


def test_terms(spark):
    t = spark.createDataFrame([("net income",), ("consolidated net income",), ("income",), (None,)], "term string")
    assert {(r.term, r.sub_term) for r in terms.sub_terms(t).collect()} == {("net income", "income"), ("consolidated net income", "net income"), ("consolidated net income", "income")}


def test_sub_terms_are_substrings(spark):
    names = ["Term Loans", "Loan", "oan", "Net Income", "a", "Term", "Ter", "ms"]
    t = spark.createDataFrame([(n,) for n in names], "term string")
    assert {(r.term, r.sub_term) for r in terms.sub_terms(t).collect()} == {(a, b) for a in names for b in names if a != b and b in a}


def test_found_terms_longest_first(spark):
    """Terms are sought from left to right, the longest first, with case; terms inside those found count, too."""
    names = ["Net Income", "Consolidated Net Income", "Loan", "Term Loan", "Income of", "J.Crew", "EBITDA", "S&P (a)"]
    texts = [(1, "The Consolidated Net Income of the Loan"), (2, "a loan and Loans"), (3, "Term Loan, J.Crew and JxCrew"), (4, None), (5, ""), (None, "EBITDA"), (6, "Net Income of"), (7, "the S&P (a)b")]
    pattern = re.compile(r"\b(?:" + "|".join(re.escape(n) for n in sorted(names, key=len, reverse=True)) + r")\b")
    want = set()
    for i, text in texts:
        for hit in pattern.findall(text or ""):
            want |= {(i, n) for n in names if n in hit}
    frame, known = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(n,) for n in [*names, None, ""]], "term string")
    assert {(r.id, r.term) for r in terms.found_terms(frame, known, "id").collect()} == want and (1, "Net Income") in want and (6, "Income of") not in want
    by = spark.createDataFrame([(1, "Loan"), (2, "Term Loan")], "doc int, term string")
    both = spark.createDataFrame([(1, 10, "Term Loan"), (2, 20, "Term Loan")], "doc int, id long, text string")
    assert {(r.doc, r.term) for r in terms.found_terms(both, by, "id", "doc").collect()} == {(1, "Loan"), (2, "Term Loan")}


@pytest.mark.parametrize("size", [1 << 21, 0])
def test_terms_by_automaton_against_patterns(spark, monkeypatch, size):
    """Whether the dictionary goes to each executor or meets its texts by a join, an alternation finds the same."""
    monkeypatch.setattr(terms, "DICTIONARY", size)
    rng = random.Random(5)
    letters = ["a", "b", "ab", " ", "-", "&", ".", "é", "e\u0301", "_", "1", "²", "😀", "A"]
    made = lambda n: "".join(rng.choice(letters) for _ in range(rng.randrange(1, n)))
    names = sorted({made(5) for _ in range(60)} | {"&", "a.b", "-", " "})
    texts = [(k, made(40)) for k in range(300)] + [(300, "a&b"), (301, "&"), (302, None), (303, ""), (None, "a b")]
    word = lambda t, k: 0 <= k < len(t) and regex.match(r"\w", t[k]) is not None
    borders = lambda t, k, n: word(t, k - 1) != word(t, k) and word(t, k + n - 1) != word(t, k + n)
    by_length, want, held = sorted(names, key=len, reverse=True), set(), set()
    for i, t in texts:
        at = 0
        while t and at < len(t):
            hit = next((n for n in by_length if t.startswith(n, at) and borders(t, at, len(n))), None)
            want |= {(i, n) for n in names if hit and n in hit}
            at += len(hit) if hit else 1
        low = (t or "").lower()
        held |= {(i, n.lower()) for n in names if any(low.startswith(n.lower(), k) and borders(low, k, len(n)) for k in range(len(low)))}
    frame, known = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(n,) for n in [*names, None, ""]], "term string")
    got = [(r.id, r.term) for r in terms.found_terms(frame, known, "id").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 300
    assert {(r.id, r.term) for r in terms.held_phrases(frame, known, "id").collect()} == held
    assert terms.found_terms(frame, known.limit(0), "id").count() == 0 and terms.found_terms(frame.limit(0), known, "id").count() == 0


def test_terms_of_many_groups(spark, monkeypatch):
    """More groups in a task than it keeps automata for; texts of null groups and of groups without terms name none."""
    monkeypatch.setattr(terms, "AUTOMATA", 2)
    known = spark.createDataFrame([(g % 7, f"Term {g % 5}") for g in range(35) if g % 7 != 3] + [(None, "Term 1"), (4, None)], "doc int, term string")
    texts = [(g % 9 if g % 11 else None, g, f"of Term {g % 5} and term 1") for g in range(99)]
    got = {(r.doc, r.id, r.term) for r in terms.found_terms(spark.createDataFrame(texts, "doc int, id int, text string"), known, "id", "doc").collect()}
    assert got == {(d, i, f"Term {i % 5}") for d, i, _ in texts if d is not None and d < 7 and d != 3}


def test_phrases_of_several_words(spark):
    texts = [(1, "A Trap Door? (IP-stripping), e.g. J.Crew"), (2, "trapdoor strap door"), (3, "net  income"), (4, "Net income."), (5, None), (6, ""), (7, "EBITDA"), (None, "the trap door")]
    phrases = ["trap door", "IP-Stripping", "j.crew", "net income", "door", "jxcrew", "ebit", None, ""]
    frame = spark.createDataFrame(texts, "question_id long, text string")
    got = {(r.question_id, r.term) for r in terms.held_phrases(frame, spark.createDataFrame([(p,) for p in phrases], "term string"), "question_id").collect()}
    want = {(i, p.lower()) for i, t in texts for p in phrases if t and p and re.search(rf"\b{re.escape(p)}\b", t, re.IGNORECASE)}
    assert got == want and {(1, "trap door"), (1, "ip-stripping"), (None, "trap door")} <= got
    asked = frame.withColumnRenamed("text", "question")
    concepts = spark.createDataFrame([("leak", "trap door"), ("leak", "door"), ("pay", "net income")], "concept_id string, alias string")
    found = {(r.question_id, r.concept_id, r.alias) for r in knowledge.concept_matches(asked, concepts).collect()}
    assert found == {(1, "leak", "trap door"), (2, "leak", "door"), (None, "leak", "trap door"), (4, "pay", "net income")}
    synonyms = spark.createDataFrame([(1, 0, "EBIT"), (1, 1, "Operating profit"), (1, 2, "earnings"), (2, 0, "net income"), (2, 1, "net profit"), (3, 0, "ip"), (3, 1, "patents")], "group_id int, pos int, term string")
    assert {(r.question_id, tuple(r.terms)) for r in knowledge.synonym_terms(asked, synonyms).collect()} == {(7, ("Operating profit", "earnings")), (4, ("net profit",))}


def test_dimension_rows_without_names_go(spark, tmp_path):
    rows = [("leak", ["trap door"]), ("none", []), ("null", None), ("", ["x"]), (None, ["y"])]
    spark.createDataFrame(rows, "concept_id string, aliases array<string>").write.json(str(tmp_path / "c"))
    got = knowledge.load_dimension(spark, str(tmp_path / "c"), "concept_id string, aliases array<string>", ("concept_id", "aliases")).collect()
    assert [r.concept_id for r in got] == ["leak"]


def test_store(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/chunks", "m1")
    chunks = spark.createDataFrame([("c1", "t", "other", 0, [1.0], "d1"), ("c2", "t", "other", 0, [1.0], "d2")], "chunk_id string, text string, section_type string, chunk_index int, embedding array<float>, document_id string")
    store.add(chunks)
    again = ChunkStore(spark, f"file://{tmp_path}/chunks", "m1")
    assert again.chunks("d1").count() == 1 and again.documents().count() == 2
    again.delete("d1")
    assert [r.document_id for r in again.documents().collect()] == ["d2"]
    with pytest.raises(Exception, match="another model"):
        ChunkStore(spark, f"file://{tmp_path}/chunks", "m2").chunks("d2").collect()
    docs = spark.createDataFrame([("x",), ("x",), ("y",)], "content string")
    assert again.new_documents(docs, "content").count() == 2


def test_markdown_table(spark):
    frame = spark.createDataFrame([([["a", None], ["b\nc", "d"]], ["h", "i"])], "r array<array<string>>, h array<string>")
    assert frame.select(markdown_table(F.col("r"), F.col("h")).alias("x")).first().x == "| h | i |\n| --- | --- |\n| a |  |\n| b c | d |"


def test_streams(spark, tmp_path):
    rows = spark.read.parquet(f"{DATA}/conversations.parquet")
    rows.select("conv_id", "turn", "text", F.timestamp_seconds(F.lit(1000)).alias("ts")).repartition(2).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("conv_id long, turn long, text string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for name, frame, mode in (("new", ingest.new_content(source, "text", "ts"), "append"), ("memory", ingest.remembered(source), "update")):
        run = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        run.awaitTermination(120)
        assert run.exception() is None
    assert spark.table("new").count() == rows.select("text").distinct().count()
    last = {}
    for r in spark.table("memory").collect():
        last.setdefault(r.conv_id, []).append([t.turn for t in r.turns])
    want = {r.conv_id: sorted(r.t)[-3:] for r in rows.groupBy("conv_id").agg(F.collect_list("turn").alias("t")).collect()}
    assert set(last) == set(want) and all(want[c] in last[c] for c in want)


def test_entry_without_training_data_operators(tmp_path):
    """In a copy without the training-data folders and the pipeline the entry module imports, and all other queries are there."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(*sorted(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert done.stdout.split() == sorted(catalog.QUERIES)


def test_plugins(spark):
    from lodestar.functions import plugins

    texts = spark.createDataFrame([(1, "a b a"), (2, None)], "id int, text string")
    assert [list(r.embedding) for r in plugins.embed(texts, lambda: lambda ts: [[float(len(t))] for t in ts]).collect()] == [[5.0], [0.0]]
    assert sum(texts.select(plugins.hashed_embedding(F.col("text"), 8).alias("v")).first().v) == 3
    prompts = spark.createDataFrame([(1, "say hi"), (2, "fail")], "id int, prompt string")

    class Echo:
        name = "echo"

        def complete(self, prompt):
            if prompt == "fail":
                raise ValueError("no answer")
            return prompt.upper()

    got = {r.id: (r.text, r.status) for r in plugins.complete(prompts, Echo).collect()}
    assert got == {1: ("SAY HI", "complete"), 2: ("no answer", "error")}
    assert plugins.validate({"model": "", "min_score": 2}) == ["model is empty", "min_score is not between 0 and 1"]


def test_gate_and_merges(spark):
    hits = spark.createDataFrame([(1, p, s, d) for p, s, d in ((1, 0.9, 10), (2, 0.8, 11), (3, 0.7, 12), (4, 0.6, 13), (5, 0.5, 14))], "query_id int, pos int, score double, doc_id long")
    order = [r.doc_id for r in fusion.lost_in_the_middle(hits).orderBy("place").collect()]
    assert order == [10, 12, 14, 13, 11]
    more = spark.createDataFrame([(1, 1, 12), (1, 2, 20), (1, 3, 21)], "query_id int, pos int, doc_id long")
    assert [r.doc_id for r in fusion.merge_results(hits, more, 6).orderBy("pos").collect()] == [10, 11, 12, 13, 14, 20]
    lists = spark.createDataFrame([(0, q, r, d) for q, r, d in ((1, 1, 5), (2, 1, 6), (1, 2, 6), (2, 2, 7), (1, 3, 8))], "group_id int, query_idx int, rank int, doc_id long")
    assert [r.doc_id for r in fusion.round_robin(lists, 3).orderBy("pos").collect()] == [5, 6, 7]
    questions = spark.createDataFrame([(1, "What about liens?"), (2, "the")], "query_id int, query string")
    texts = hits.withColumn("text", F.lit("LIENS are here"))
    got = {r.query_id: r.decision for r in fusion.quality_gate(texts, questions).collect()}
    assert got == {1: "sufficient", 2: "insufficient"}


def plain_chunks(text, limit, overlap):
    """What overlapping chunks should be, one paragraph at a time."""
    import re

    count = lambda t: len(t.split())
    parts = [p.strip() for p in re.split(r"\n\s*\n|\n\s*(?=\([a-z]\)|\([ivx]+\))", text) if p.strip()]
    parts = parts if len(parts) > 1 else [p.strip() for p in text.split("\n") if p.strip()]
    done, held = [], []
    for part in parts:
        if held and sum(map(count, held)) + count(part) > limit:
            done.append("\n\n".join(held))
            for source, glue in ((held, None), (re.split(r"(?<=\.)\s+", held[-1]), " ")):
                tail = []
                for piece in reversed(source):
                    if sum(map(count, tail)) + count(piece) > overlap:
                        break
                    tail.insert(0, piece)
                if tail:
                    break
            held = ([glue.join(tail)] if glue else tail) if tail else []
        held = [*held, part]
    return done + (["\n\n".join(held)] if held else [])


def test_overlapping_chunks(spark):
    import random

    rng = random.Random(3)
    sentence = lambda: " ".join("w" * rng.randrange(1, 5) for _ in range(rng.randrange(1, 9))) + "."
    texts = ["", "one", *("".join(" ".join(sentence() for _ in range(rng.randrange(1, 5))) + rng.choice(["\n", "\n\n", "\n(a) "]) for _ in range(rng.randrange(12))) for _ in range(60))]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", segments.overlapping_chunks(F.col("text"), 30, 10).alias("x"))
    for r in frame.collect():
        assert r.x == plain_chunks(texts[r.id], 30, 10)


def test_insert_within(spark):
    import random

    rng = random.Random(5)
    hits, new, want = [], [], {}
    for q in range(40):
        held = [(q, p, 10 * p, rng.choice("ab"), rng.randrange(9) / 10, rng.random() < 0.3) for p in range(1, rng.randrange(2, 6))]
        more = [(q, p, 1000 + p, rng.choice("ab"), rng.randrange(9) / 10) for p in range(1, rng.randrange(1, 6))]
        out = [h[2:] for h in held]
        for m in more:
            if len(out) < 4:
                out.append((*m[2:], False))
                continue
            free = [(h[2], i) for i, h in enumerate(out) if not h[3] and h[1] != m[3]]
            if free and m[4] >= min(free)[0]:
                out[min(free)[1]] = (*m[2:], False)
        hits, new, want[q] = hits + held, new + more, out
    h = spark.createDataFrame(hits, "query_id int, pos int, doc_id long, section string, score double, definition boolean")
    c = spark.createDataFrame(new, "query_id int, pos int, doc_id long, section string, score double")
    got = {}
    for r in fusion.insert_within(h, c, 4).orderBy("query_id", "pos").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.section, r.score, r.definition))
    assert got == want


def test_scores_of_a_block_are_held_a_strip_at_a_time():
    import tracemalloc

    import numpy as np

    from lodestar.operators.lexical import EXACT
    from lodestar.operators.vectors import best_of

    random = np.random.default_rng(1)
    own = random.integers(-2, 3, (8192, 4)).astype(float) + 0.5  # many equal scores
    own /= np.sqrt((own**2).sum(axis=1))[:, None]
    asked = own[:1024]
    tracemalloc.start()
    row, column, score = best_of(asked, own, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < asked.shape[0] * own.shape[0] * 8  # less than one matrix of all scores
    full = np.round((1 + asked[:50] @ own.T) / 2, EXACT)
    assert column[: 50 * 10].reshape(50, 10).tolist() == np.argsort(-full, axis=1, kind="stable")[:, :10].tolist()
    assert (np.bincount(row) == 10).all() and np.allclose(score[:10], full[0, column[:10]])
    assert [len(x) for x in best_of(asked[:3], own[:2], 10)] == [6, 6, 6]
