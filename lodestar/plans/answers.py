"""Queries over answers built from orders: what they cite, which part is the answer, and prompts and reports made with them.

An answer has a sentence with a marker for each line of an order, a block of references, its confidence and a line of sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import answers as A
from lodestar.functions.plugins import Completer
from lodestar.functions.text import confidence
from lodestar.operators import citations, dialogue, prompts
from lodestar.plans.agreements import CAP
from lodestar.plans.catalog import HYBRID_SQL, digest, hybrid_hits, query, questions
from lodestar.sources import store
from lodestar.sources.report_store import ReportStore

BASE = f"""lines AS (SELECT l_orderkey AS id, l_linenumber AS n, min(l_partkey) AS p FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY ALL),
named AS (SELECT id, n, p, p % 5 + 1 AS m, {CAP} AS name, row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS pos, count(*) OVER (PARTITION BY id) AS k FROM lines JOIN part ON p_partkey = p),
cited AS (SELECT id, pos, CASE WHEN n % 2 = 0 THEN '7.0' || n || '(b)' ELSE '7.0' || n END AS section_id, n, CASE WHEN n % 2 = 1 THEN [n, n + 1] ELSE [] END AS pages FROM named)"""
SENTENCE = "'Section 7.0' || n || '(a) allows $' || n || ',000 million for ' || name || ' [' || {0} || '].'"


def lines(read) -> DataFrame:
    """(id, n, p, name) of orders' lines: the smallest part of each line, if it is known. Lines meet their parts first, so that all that
    follows stays where a shuffle by id has put it."""
    parts = read("part").select(F.col("p_partkey").alias("p"), F.struct(F.initcap("p_name").alias("name")).alias("known"))
    own = read("lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p")).where("p IS NOT NULL").join(parts, "p", "left")
    own = own.repartition("id").groupBy("id", "n").agg(F.min(F.struct("p", "known")).alias("x")).where("x.known IS NOT NULL")
    return own.join(read("orders").select(F.col("o_orderkey").alias("id")), "id", "left_semi").select("id", "n", "x.p", "x.known.name")


def answers(read, marker=None) -> DataFrame:
    """(id, text); the marker of a line is its number, or what ``marker`` says."""
    mark = F.col("n") if marker is None else marker
    odd = lambda v: v["n"] % 2 == 1
    pages = lambda v: F.concat(F.lit(" (pp. "), v["n"], F.lit("-"), v["n"] + 1, F.lit(")"))
    quote = lambda v: F.when(v["n"] % 3 == 0, F.concat(F.lit(' -- "quote '), v["n"], F.lit('"'))).otherwise("")
    sentence = lambda v: F.concat(F.lit("Section 7.0"), v["n"], F.lit("(a) allows $"), v["n"], F.lit(",000 million for "), v["name"], F.lit(" ["), v["mark"], F.lit("]."))
    reference = lambda v: F.concat(F.lit("["), v["n"], F.lit("] Section 7.0"), v["n"], F.lit("(a)"), F.when(odd(v), pages(v)).otherwise(""), quote(v))
    source = lambda v: F.concat(F.lit("Section 7.0"), v["n"], F.when(odd(v), pages(v)).otherwise("(b)"))
    each = F.transform("x", lambda v: F.struct(sentence(v).alias("s"), reference(v).alias("r"), source(v).alias("c")))
    joined = lambda name, by: F.array_join(F.transform("t", lambda v: v[name]), by)
    text = F.concat(joined("s", " "), F.lit("\n\nReferences:\n"), joined("r", "\n"), F.lit("\n\n**Confidence:** HIGH\nSources: "), joined("c", ", "))
    rows = lines(read).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", mark.alias("mark"), "name"))).alias("x"))
    return rows.select("id", each.alias("t")).select("id", text.alias("text"))


def chunks(read) -> DataFrame:
    """(id, pos, section_id, section_title, pages, score, text): a general chunk of each line's section, and one that names its part."""
    row = lambda at, score, text: F.struct((F.col("n") * 2 + at).alias("pos"), F.concat(F.lit("7.0"), "n").alias("section_id"), F.concat(F.lit(f"Title {at} of "), "n").alias("section_title"), F.array(F.col("n") + 10).alias("pages"), F.lit(score).alias("score"), text.alias("text"))
    return lines(read).select("id", F.explode(F.array(row(0, 0.9, F.lit("General terms")), row(1, 0.5, F.concat(F.lit("Terms of the "), "name")))).alias("c")).select("id", "c.*")


@query(f"WITH {BASE} SELECT id, pos, section_id, array_to_string(pages, ',') AS pages FROM cited")
def answer_sources(read):
    found = citations.numbered_rows(answers(read), A.listed_sources, "id")
    return found.select("id", F.col("pos").cast("long").alias("pos"), "section_id", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"))


@query(f"WITH {BASE} SELECT id, n AS number, '7.0' || n || '(a)' AS section_id, array_to_string(pages, ',') AS pages, CASE WHEN n % 3 = 0 THEN 'quote ' || n ELSE '' END AS quote FROM cited")
def answer_references(read):
    found = citations.numbered_rows(answers(read), A.references, "id")
    return found.select("id", "number", "section_id", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"), "quote")


@query(f"WITH {BASE} SELECT id, md5(string_agg({SENTENCE.format('n')}, ' ' ORDER BY n)) AS body_md5, 'HIGH' AS confidence FROM named GROUP BY id")
def parsed_answers(read):
    return answers(read).select("id", digest(A.plain_body(F.col("text"))).alias("body_md5"), confidence(F.col("text")).alias("confidence"))


@query(f"""WITH {BASE}, f AS (SELECT id, m, min(n) AS first FROM named WHERE m <= 4 GROUP BY ALL), o AS (SELECT id, m, row_number() OVER (PARTITION BY id ORDER BY first) AS new FROM f)
SELECT named.id, md5(string_agg({SENTENCE.format("coalesce(new, named.m)")}, ' ' ORDER BY n)) AS body_md5, CAST(count(DISTINCT new) AS INT) AS cited FROM named LEFT JOIN o ON o.id = named.id AND o.m = named.m GROUP BY named.id""")
def rewritten_answers(read):
    """Markers of four sources are numbered anew by first appearance; a fifth names none and stays."""
    given = answers(read, F.col("p") % 5 + 1)
    bodies = given.select("id", A.answer_body(F.col("text")).alias("text"))
    sources = given.select("id", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("number"))
    return citations.rewritten(bodies, sources, "id").select("id", digest(F.col("body")).alias("body_md5"), F.size("numbers").alias("cited"))


@query(f"WITH {BASE} SELECT id, section_id, 'Title 0 of ' || n AS section_title, CASE WHEN n % 2 = 1 THEN n || ',' || (n + 1) ELSE (n + 10)::VARCHAR END AS pages, 'General terms' AS snippet FROM cited")
def enriched_citations(read):
    cited = citations.numbered_rows(answers(read), A.listed_sources, "id")
    found = citations.enriched(cited, chunks(read), "id")
    return found.select("id", "section_id", "section_title", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"), "snippet")


@query(f"WITH {BASE} SELECT id, n AS number, '7.0' || n || '(a)' AS section_id, 'Title 1 of ' || n AS section_title, CASE WHEN n % 2 = 1 THEN n || ',' || (n + 1) ELSE (n + 10)::VARCHAR END AS pages, CASE WHEN n % 3 = 0 THEN 'quote ' || n ELSE 'Terms of the ' || name END AS snippet FROM named")
def inline_citations(read):
    given = answers(read)
    bodies = given.select("id", A.answer_body(F.col("text")).alias("body"))
    found = citations.enriched_inline(citations.numbered_rows(given, A.references, "id"), chunks(read), bodies, "id")
    return found.select("id", "number", "section_id", "section_title", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"), "snippet")


@query(f"""WITH {BASE} SELECT named.id, named.n AS number, CASE WHEN named.n % 2 = 1 THEN '7.0' || named.n ELSE c.section_id END AS section_id FROM named LEFT JOIN cited c ON c.id = named.id AND c.pos + 1 = named.n
WHERE named.n % 2 = 1 OR c.section_id IS NOT NULL""")
def citations_near_sections(read):
    given = answers(read)
    bodies = given.select("id", A.answer_body(F.col("text")).alias("body"))
    return citations.from_sources(bodies, citations.numbered_rows(given, A.listed_sources, "id"), "id")


@query(f"WITH {BASE}, s AS (SELECT id, n, ['$' || n || ',000 million', name] AS w FROM named) SELECT id, n AS number, list_last(w) AS word FROM s")
def marker_keywords(read):
    """The last word or phrase before each marker."""
    near = answers(read).select("id", F.explode(A.marker_windows(A.answer_body(F.col("text")), A.KEYWORD_CHARS)).alias("w"))
    return near.select("id", F.col("w.number").alias("number"), F.element_at(A.keywords(F.col("w.window")), -1).alias("word"))


@query(f"WITH {BASE} SELECT id, n, '7.0' || n || '(a)(ii)' AS one, '7.0' || n || '(a)' AS two, '7.0' || n AS three FROM lines")
def section_parents(read):
    up = A.section_candidates(F.concat(F.lit("7.0"), "n", F.lit("(a)(ii)")))
    return lines(read).select("id", "n", F.get(up, 0).alias("one"), F.get(up, 1).alias("two"), F.get(up, 2).alias("three"))


# questions

ASKED = f"SELECT p_partkey AS question_id, 'what is the ' || {CAP} || ' Interest rate and LC fee of item ' || p_partkey AS q, {CAP} AS name FROM part"


@query(f"""WITH a AS ({ASKED}) SELECT question_id, unnest([0, 1, 2]) AS query_idx, unnest([q, 'definition ' || name || ' Interest LC Applicable Rate interest rate', q || ' rate interest']) AS query FROM a""")
def baseline_queries(read):
    """Capitalised phrases, acronyms and known aliases, then financial words; the phrase takes in the capital word that follows it."""
    asked = F.concat(F.lit("what is the "), F.initcap("p_name"), F.lit(" Interest rate and LC fee of item "), "p_partkey")
    return read("part").select(F.col("p_partkey").alias("question_id"), F.posexplode(A.baseline_queries(asked)).alias("query_idx", "query"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name || ' restated' ELSE 'question ' || c_custkey END AS question FROM customer""")
def reformulated(read):
    """Made questions that are empty or too long give way to the question itself."""
    made = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" "), "c_name", F.lit(" restated\n"))).when(F.col("c_custkey") % 3 == 1, F.lit("  ")).otherwise(F.repeat("c_name", 40))
    return read("customer").select("c_custkey", A.accepted_reformulation(made, F.concat(F.lit("question "), "c_custkey")).alias("question"))


@query(r"""WITH w AS (SELECT item_id, unnest(list_distinct(list_transform(list_filter(regexp_split_to_array(text, '[^a-zA-Z0-9_]+'), lambda w: length(w) >= 4), lambda w: lower(w)))) AS word FROM benchmark)
SELECT item_id, word FROM w WHERE word NOT IN (""" + ", ".join(f"'{w}'" for w in A.QUERY_STOP_WORDS) + ")")
def query_keywords(read):
    return read("benchmark").select("item_id", F.explode(A.query_keywords(F.col("text"))).alias("word"))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN true WHEN o_orderpriority LIKE '2%' THEN true ELSE false END AS overlaps FROM orders")
def synonym_overlap(read):
    """'Spreads' reaches a text about margins by the synonyms of its singular; 'liens' one about collateral."""
    from lodestar.functions.text import terms_overlap

    asked = F.when(F.col("o_orderpriority").startswith("1"), "Spreads?").otherwise("the liens of")
    text = F.when(F.col("o_orderpriority").startswith("1"), "the applicable margin").when(F.col("o_orderpriority").startswith("2"), "all Collateral").otherwise("taxes")
    return read("orders").select("o_orderkey", terms_overlap(asked, text, 1, A.with_synonyms).alias("overlaps"))


# prompts and reports


@query(f"""WITH {HYBRID_SQL}, h AS (SELECT query_id, doc_id, score, text, lang, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY query_id) AS n FROM hits JOIN documents d USING (doc_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n <= 2 OR r % 2 = 1 THEN r ELSE 2 * n + 2 - r END) AS place FROM h),
s AS (SELECT query_id, string_agg('[Source ' || (place + 1) || '] Title ' || doc_id || ' (Section ' || lang || ', pp. ' || (doc_id % 9) || '-' || (doc_id % 9 + 1) || ')' || chr(10) || text || chr(10), chr(10) ORDER BY place) AS t FROM o GROUP BY query_id)
SELECT item_id AS query_id, md5('=== CONTEXT FROM CREDIT AGREEMENT ===' || chr(10) || chr(10) || '[Source 1] Preamble and Recitals (pp. n/a)' || chr(10) || 'Opening of ' || item_id || chr(10) || coalesce(chr(10) || t, '') || chr(10) || chr(10) || '=== RELEVANT DEFINITIONS ===' || chr(10) || '"Item" means item ' || item_id || '.'
    || chr(10) || chr(10) || '=== CURRENT QUESTION ===' || chr(10) || b.text) AS prompt_md5 FROM benchmark b LEFT JOIN s ON s.query_id = item_id""")
def context_prompts(read):
    """An opening, hits with the best first and last, and the definition that no hit holds; another that a hit holds is left out."""
    hits = _shown(read)
    asked = questions(read).select("query_id", F.col("query").alias("question"))
    opening = asked.select("query_id", F.lit(None).cast("array<int>").alias("pages"), F.concat(F.lit(" Opening of "), "query_id", F.lit("\n")).alias("text"))
    own = asked.select("query_id", F.lit(1).alias("pos"), F.lit("Item").alias("term"), F.concat(F.lit("item "), "query_id", F.lit(".")).alias("text"))
    known = hits.where("pos = 1").select("query_id", F.lit(2), F.lit("Known"), "text")
    defined = prompts.new_definitions(own.union(known), hits)
    return prompts.contexts(asked, prompts.numbered_sources(hits, opening), defined).select("query_id", digest(F.col("prompt")).alias("prompt_md5"))


def _shown(read) -> DataFrame:
    docs = read("documents").select("doc_id", "text", F.col("lang").alias("section_id"), F.concat(F.lit("Title "), "doc_id").alias("section_title"), F.array((F.col("doc_id") % 9).cast("int"), (F.col("doc_id") % 9 + 1).cast("int")).alias("pages"), F.col("source").alias("article"), F.col("doc_id").alias("chunk_index"))
    return hybrid_hits(read).join(docs, "doc_id")


@query(f"""WITH {HYBRID_SQL}, h AS (SELECT query_id, doc_id, text, lang, row_number() OVER (PARTITION BY query_id ORDER BY d.source, lang, doc_id) AS place FROM hits JOIN documents d USING (doc_id)),
s AS (SELECT query_id, string_agg('[Source ' || place || '] Title ' || doc_id || ' (Section ' || lang || ', pp. ' || (doc_id % 9) || '-' || (doc_id % 9 + 1) || ')' || chr(10) || text || chr(10), chr(10) ORDER BY place) AS t FROM h GROUP BY query_id)
SELECT item_id AS query_id, md5('=== CONTEXT FROM CREDIT AGREEMENT ===' || chr(10) || coalesce(chr(10) || t, '') || chr(10) || chr(10) || '=== EXTRACTION TASK ===' || chr(10) || 'Extract ' || item_id) AS prompt_md5 FROM benchmark LEFT JOIN s ON s.query_id = item_id""")
def extraction_prompts(read):
    asked = questions(read).select("query_id", F.concat(F.lit("Extract "), "query_id").alias("question"))
    return prompts.contexts(asked, prompts.numbered_sources(_shown(read), by_document=True), task=True).select("query_id", digest(F.col("prompt")).alias("prompt_md5"))


@query(f"""WITH {HYBRID_SQL} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place, lang AS section, 'Title ' || doc_id AS title, round(score, 3) AS relevance, (doc_id % 9) || ', ' || (doc_id % 9 + 1) AS pages FROM (SELECT query_id, doc_id, score, d.lang FROM hits JOIN documents d USING (doc_id))""")
def shown_hits(read):
    return prompts.shown_hits(_shown(read))


PAIRS = """q AS (SELECT *, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS qt FROM conversations),
pairs AS (SELECT a.conv_id, a.qt AS turn, any_value(u.text) AS question, arg_min(a.text, a.turn) AS answer FROM q a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.qt WHERE a.role = 'assistant' AND length(a.text) > 0 GROUP BY a.conv_id, a.qt)"""


@query(f"""WITH {PAIRS} SELECT conv_id AS query_id, md5('Conversation:' || chr(10) || string_agg('User: ' || question || chr(10) || 'Assistant: ' || answer, chr(10) ORDER BY turn) || chr(10) || chr(10) || 'Latest question: and ' || conv_id || chr(10) || chr(10) || 'Reformulated search query:') AS prompt_md5 FROM pairs GROUP BY conv_id""")
def reformulation_prompts(read):
    history = dialogue.pairs(read("conversations")).withColumnRenamed("conv_id", "query_id")
    asked = read("conversations").select(F.col("conv_id").alias("query_id")).distinct().withColumn("question", F.concat(F.lit("and "), "query_id"))
    return prompts.reformulation_prompts(asked, history).select("query_id", digest(F.col("prompt")).alias("prompt_md5"))


@query("""SELECT conv_id, turn, 'base' || CASE WHEN turn % 2 = 0 THEN ' short' ELSE '' END || CASE WHEN role = 'user' THEN ' comments' ELSE '' END AS text, CASE WHEN role = 'user' THEN 2048 ELSE 1024 END AS tokens FROM conversations""")
def instructions(read):
    text, most = prompts.instructions("base", {"concise": " short", "commentary": " comments"}, {"concise": F.col("turn") % 2 == 0, "commentary": F.col("role") == "user"}, 1024)
    return read("conversations").select("conv_id", "turn", text.alias("text"), most.alias("tokens"))


@query("""WITH q AS (SELECT c_custkey AS query_id, 'about ' || c_name AS query, c_acctbal < 0 AND c_nationkey < 12 AS open FROM customer)
SELECT query_id, 0 AS query_idx, query FROM q WHERE NOT open UNION ALL SELECT query_id, i, 'part ' || i FROM q, unnest([0, 1]) t(i) WHERE open""")
def decomposed_questions(read):
    own = read("customer").select(F.col("c_custkey").alias("query_id"), F.concat(F.lit("about "), "c_name").alias("question"), F.when(F.col("c_acctbal") < 0, "insufficient").otherwise("sufficient").alias("decision"), "c_nationkey")
    made = own.select("query_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("query_idx")).withColumn("query", F.concat(F.lit("part "), "query_idx"))
    return prompts.decomposed(own.select("query_id", "question"), own, own.where("c_nationkey < 12"), made)


@query("""WITH t AS (SELECT r_regionkey AS s, unnest([0, 1]) AS i FROM region) SELECT n_nationkey AS report_id, s AS section_number, i AS query_idx, 'query ' || i || ' of ' || s AS query, CASE WHEN i = 1 THEN 'collateral' END AS section_filter, CASE WHEN i = 0 THEN 'miscellaneous' END AS exclude, 10 + s AS top_k FROM nation, t""")
def report_queries(read):
    """Each region is a template of two queries; each nation a document."""
    one = lambda i, kind: F.struct(F.concat(F.lit(f"query {i} of "), "r_regionkey").alias("query"), F.lit(kind).cast("string").alias("section_filter"))
    templates = read("region").select(F.col("r_regionkey").alias("section_number"), F.col("r_name").alias("title"), (F.col("r_regionkey") + 10).alias("top_k"), F.array(one(0, None), one(1, "collateral")).alias("queries"))
    made = prompts.report_queries(templates, read("nation").select(F.col("n_nationkey").alias("report_id")))
    return made.withColumn("exclude", F.array_join("exclude", ","))


class Echo:
    """A completer that repeats a prompt in capitals and fails on some."""

    name = "echo"

    def complete(self, prompt: str) -> str:
        if prompt.endswith("7"):
            raise ValueError("no seven")
        return prompt.upper()


def echo() -> Completer:
    return Echo()


@query("""SELECT c_nationkey AS report_id, c_custkey AS section_number, 'fresh' AS body, 'complete' AS status FROM customer WHERE c_custkey % 10 = 7 AND c_acctbal > 0
UNION ALL SELECT c_nationkey, c_custkey, CASE WHEN c_custkey % 10 <> 7 THEN upper(c_name) END, CASE WHEN c_custkey % 10 = 7 THEN 'error' ELSE 'complete' END FROM customer WHERE NOT (c_custkey % 10 = 7 AND c_acctbal > 0)""")
def generated_sections(read):
    """A section per customer in one job; those that fail are rows with their error, and some of them are made again."""
    asked = read("customer").select(F.col("c_nationkey").alias("report_id"), F.col("c_custkey").alias("section_number"), F.lit("Terms").alias("title"), F.col("c_name").alias("prompt"), "c_acctbal")
    made = prompts.generated(asked.drop("c_acctbal"), echo)
    again = asked.where("section_number % 10 = 7 AND c_acctbal > 0").select("report_id", "section_number", "title", F.lit("fresh").alias("body"), F.lit("complete").alias("status"), F.lit(None).cast("string").alias("error"))
    return prompts.regenerated(made, again).select("report_id", "section_number", "body", "status")


@query("""WITH s AS (SELECT c_nationkey AS id, c_custkey AS n, CASE WHEN c_custkey % 10 = 7 THEN 'GENERATION ERROR: failed' WHEN c_custkey % 10 = 8 THEN '(Not yet generated)' ELSE 'Body' || chr(10) || chr(10) || 'Confidence: HIGH' || chr(10) || 'Sources: Section 7.1 (pp. 3, 4), Section 8' END AS t FROM customer)
SELECT id AS report_id, md5('# Report ' || id || chr(10) || string_agg(chr(10) || '---' || chr(10) || chr(10) || '## Section ' || n || ': Terms' || chr(10) || chr(10) || t, chr(10) ORDER BY n) || chr(10) || chr(10) || '---' || chr(10) || 'end' || chr(10)) AS markdown_md5 FROM s GROUP BY id""")
def section_reports(read):
    last = F.col("c_custkey") % 10
    cited = F.array(F.struct(F.lit("7.1").alias("section_id"), F.array(F.lit(3), F.lit(4)).alias("pages")), F.struct(F.lit("8").alias("section_id"), F.array().cast("array<int>").alias("pages")))
    sections = read("customer").select(F.col("c_nationkey").alias("report_id"), F.col("c_custkey").alias("section_number"), F.lit("Terms").alias("title"), F.lit("Body").alias("body"), F.when(last == 7, "error").when(last == 8, "pending").otherwise("complete").alias("status"), F.lit("failed").alias("error"), F.lit("HIGH").alias("confidence"), cited.alias("sources"))
    heads = sections.select("report_id").distinct().select("report_id", F.concat(F.lit("# Report "), "report_id").alias("heading"), F.lit("end").alias("closing"))
    return prompts.markdown_reports(sections, heads).select("report_id", digest(F.col("markdown")).alias("markdown_md5"))


class Steady(Echo):
    """Answers whatever comes."""

    def complete(self, prompt: str) -> str:
        return prompt.upper()


def steady() -> Completer:
    return Steady()


@query("""WITH s AS (SELECT c_custkey, c_name, 1 AS section_number, NULL AS r_name FROM customer UNION ALL SELECT c_custkey, c_name, r_regionkey + 2, r_name FROM customer, region)
SELECT c_custkey AS report_id, section_number::BIGINT AS section_number, CASE WHEN section_number = 1 THEN upper('Borrower: ' || c_name) ELSE upper('Terms of ' || CASE WHEN c_custkey % 10 = 7 THEN '(Unknown Borrower)' ELSE upper(c_name) END || ' in ' || r_name) END AS body,
    'complete' AS status, CASE WHEN section_number = 1 THEN CASE WHEN c_custkey % 10 = 7 THEN 3 ELSE 1 END ELSE 2 END AS attempt FROM s""")
def staged_reports(read):
    """A report per customer: its first section names the borrower for the others; a second run makes what failed, and nothing else."""
    own = read("customer").select(F.col("c_custkey").alias("report_id"), "c_name")
    first = own.select("report_id", F.lit(1).cast("long").alias("section_number"), F.lit("Parties").alias("title"), F.concat(F.lit("Borrower: "), "c_name").alias("prompt"))
    rest = own.crossJoin(F.broadcast(read("region"))).select("report_id", (F.col("r_regionkey") + 2).cast("long"), "r_name", F.concat(F.lit("Terms of {borrower} in "), "r_name"))  # five templates
    reports = ReportStore(own.sparkSession, store.shared_path(own.sparkSession, "reports"))
    reports.request(first.union(rest))
    reports.resume(echo)
    return reports.resume(steady).select("report_id", "section_number", "body", "status", "attempt")


# rollups


@query("""WITH p AS (SELECT conv_id, count(*) AS pages FROM conversations GROUP BY conv_id), k AS (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY ALL)
SELECT conv_id, pages, string_agg(role || ': ' || n, ', ' ORDER BY role) AS kinds FROM p JOIN k USING (conv_id) GROUP BY conv_id, pages""")
def kinds_of_rows(read):
    """Counts of a document with a histogram sorted by kind."""
    counted = read("conversations").groupBy("conv_id", "role").agg(F.count(F.lit(1)).alias("n"))
    histogram = F.array_sort(F.collect_list(F.struct("role", "n")))
    text = F.array_join(F.transform("h", lambda x: F.concat(x["role"], F.lit(": "), x["n"])), ", ")
    return counted.groupBy("conv_id").agg(F.sum("n").alias("pages"), histogram.alias("h")).select("conv_id", "pages", text.alias("kinds"))


@query("""SELECT source AS section, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang FROM documents GROUP BY source""")
def one_citation_per_section(read):
    hits = read("documents").select(F.lit(0).alias("query_id"), F.col("source").alias("section_id"), F.col("doc_id").alias("pos"), "lang")
    first = hits.groupBy("query_id", "section_id").agg(F.min(F.struct("pos", "lang")).alias("x"))
    return first.select(F.col("section_id").alias("section"), F.col("x.pos").alias("doc_id"), F.col("x.lang").alias("lang"))


