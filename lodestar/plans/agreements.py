"""Queries over agreements, one per customer with orders: sections with pages and tables, definitions, chunks, and their injection.

Page 1 is a preamble, page 2 defines the parts that the customer's orders hold, and each order is a subsection on a page of its own,
with a table if it is finished. Rows grow with customers and orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import answers as A
from lodestar.functions.text import article_number
from lodestar.operators import chunking, injection, rollup, terms
from lodestar.plans.catalog import once, query
from lodestar.sources.store import written

CAP = "upper(substr(split_part(p_name, ' ', 1), 1, 1)) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2)"
BASE = f"""own AS (SELECT c_custkey AS doc, c_name, n_name, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS r FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN orders ON o_custkey = c_custkey),
held AS (SELECT DISTINCT doc, r, {CAP} AS name FROM own JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey),
lines AS (SELECT doc, {CAP} AS name, count(*) AS n FROM own JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL),
docs AS (SELECT DISTINCT doc, c_name, n_name FROM own)"""


SOURCES = ("customer", "nation", "orders", "lineitem", "part")


def agreement_pages(read) -> DataFrame:
    """(doc, page, text, tables) of all agreements, stored once as what a reader of files would give."""
    return once(read, "agreement-pages", SOURCES, lambda: written(_pages(read), "pages"))


def _pages(read) -> DataFrame:
    """Names of parts meet their order, and orders their customer, in one array each, so a customer's pages are made in its own row."""
    named = read("customer").join(read("nation"), F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("doc"), F.struct("c_name", "n_name").alias("party"))
    parts = read("part").select(F.col("p_partkey").alias("l_partkey"), F.initcap("p_name").alias("name"))
    items = read("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey").join(parts, "l_partkey").groupBy("o_orderkey").agg(F.collect_list("name").alias("names"))
    orders = read("orders").select(F.col("o_custkey").alias("doc"), "o_orderkey", "o_orderstatus").join(items, "o_orderkey", "left")
    own = orders.join(named, "doc").groupBy("doc").agg(F.collect_set("party").alias("parties"), F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "names"))).alias("orders"))
    none = F.array().cast("array<string>")
    page = lambda n, text, tables=none: F.struct(n.cast("int").alias("page"), text.alias("text"), tables.alias("tables"))

    def order(o: Column, i: Column) -> Column:
        head = F.when(i == 0, "ARTICLE II\nNEGATIVE COVENANTS\n").otherwise("")
        names = F.coalesce(F.array_join(F.sort_array(F.array_distinct(o["names"])), ", "), F.lit("nothing"))
        text = F.concat(head, F.lit("2."), i + 1, F.lit(" Order "), o["o_orderkey"], F.lit(" Terms\nThe parties hold "), names, F.lit(" under this order"))
        table = F.when(o["o_orderstatus"] == "F", F.array(F.concat(F.lit("| order | "), o["o_orderkey"], F.lit(" |\n| --- | --- |")))).otherwise(none)
        return page(i + 3, text, table)

    def counted(held: Column) -> Column:
        """A line for each run of equal names, of which ``ends`` has the ends."""
        line = lambda ends: lambda n, k: F.concat(F.lit('"'), F.get(held, n - 1), F.lit('" means an item of which '), n - F.coalesce(F.get(ends, k - 1), F.lit(0)), F.lit(" lines are held"))
        ends = F.filter(F.sequence(F.lit(1), F.size(held)), lambda n: ~F.get(held, n).eqNullSafe(F.get(held, n - 1)))
        return F.when(F.size(held) > 0, A.once(ends, lambda e: F.array_join(F.transform(e, line(e)), "\n"))).otherwise("")

    every = F.sort_array(F.flatten(F.transform("orders", lambda o: F.coalesce(o["names"], none))))
    opening = F.transform("parties", lambda p: page(F.lit(1), F.concat(F.lit("This agreement is made between "), p["c_name"], F.lit(" and the lenders of "), p["n_name"], F.lit(" on this day"))))
    defined = page(F.lit(2), F.concat(F.lit("ARTICLE I\nDEFINITIONS\n1.01 Defined Terms\n"), A.once(every, counted)))
    return own.select("doc", F.explode(F.concat(opening, F.array(defined), F.transform("orders", order))).alias("p")).select("doc", "p.*")


@query(f"""WITH {BASE} SELECT doc, 1 AS ord, 'PREAMBLE' AS section_id, 0 AS article_number, 'Preamble and Recitals' AS title, 'preamble' AS type, 1 AS page_start, 1 AS page_end, 0 AS tables FROM docs
UNION ALL SELECT doc, 2, '1.01', 1, 'Defined Terms', 'definitions', 2, 2, 0 FROM docs
UNION ALL SELECT doc, CAST(2 + r AS INT), '2.' || r, 2, 'Order ' || o_orderkey || ' Terms', 'negative_covenants', CAST(2 + r AS INT), CAST(2 + r AS INT), CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END FROM own""")
def agreement_sections(read):
    return found_sections(read).select("doc", "ord", "section_id", "article_number", F.col("section_title").alias("title"), F.col("section_type").alias("type"), "page_start", "page_end", F.size("tables").alias("tables"))


@query(f"""WITH {BASE} SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY name) AS INT) AS ord, name AS term, '"' || name || '" means an item of which ' || n || ' lines are held' AS text, 2 AS page FROM lines""")
def agreement_definitions(read):
    return found_definitions(read).select("doc", "ord", "term", "text", "page")


def found_sections(read) -> DataFrame:
    return once(read, "agreement-sections", SOURCES, lambda: written(chunking.sections(agreement_pages(read), "doc"), "sections"))


def found_definitions(read) -> DataFrame:
    return once(read, "agreement-definitions", SOURCES, lambda: written(chunking.definitions(found_sections(read), agreement_pages(read), "doc"), "definitions"))


def agreement(read) -> tuple[DataFrame, DataFrame]:
    """(definitions, chunks)."""
    defined = found_definitions(read)
    return defined, once(read, "agreement-chunks", SOURCES, lambda: written(chunking.chunks(found_sections(read), defined, "doc"), "chunks"))


CHUNKS = """texts AS (SELECT own.doc, own.r, o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS i, (SELECT count(*) FROM held h WHERE h.doc = own.doc AND h.r = own.r) AS k FROM own)"""


@query(f"""WITH {BASE}, {CHUNKS}, c AS (SELECT doc, count(*) AS k FROM lines GROUP BY doc)
SELECT doc, 'PREAMBLE' AS section_id, 'text' AS chunk_type, 0 AS chunk_index, 14 AS n_tokens, '1' AS pages, 0 AS terms FROM docs
UNION ALL SELECT doc, '1.01', 'definition', 0, CAST(k * 11 AS INT), '2', CAST(k AS INT) FROM c
UNION ALL SELECT doc, '2.' || r, 'table', 0, 10, CAST(r + 2 AS VARCHAR), 0 FROM texts WHERE i = 1
UNION ALL SELECT doc, '2.' || r, 'text', i, CAST(CASE WHEN k = 0 THEN 11 ELSE 10 + 2 * k END AS INT), CAST(r + 2 AS VARCHAR), CAST(k AS INT) FROM texts""")
def agreement_chunks(read):
    _, made = agreement(read)
    return made.select("doc", "section_id", "chunk_type", "chunk_index", "n_tokens", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"), F.size("terms").alias("terms"))


@query(f"""WITH {BASE} SELECT doc, name AS term, substr(sha256(doc || chr(1) || '1.01' || chr(1) || 'definition' || chr(1) || '0'), 1, 12) AS chunk_id FROM lines""")
def definition_chunk_lookup(read):
    _, made = agreement(read)
    return injection.definition_chunks(made, "doc")


@query(f"""WITH {BASE}, k AS (SELECT doc, count(*) AS k FROM lines GROUP BY doc), o AS (SELECT doc, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS t FROM own GROUP BY doc)
SELECT doc, n + 2 AS page_count, n + 2 AS section_count, coalesce(k, 0) AS definition_count, n + t + 1 + CASE WHEN k > 0 THEN 1 ELSE 0 END AS chunk_count, t AS table_count,
    'definitions: 1, negative_covenants: ' || n || ', preamble: 1' AS types FROM o LEFT JOIN k USING (doc)""")
def agreement_statistics(read):
    """One rollup over pages, sections, definitions and chunks, in two halves that are merged."""
    defined, made = agreement(read)
    halves = [(f(agreement_pages(read)), f(found_sections(read)), f(defined), f(made)) for f in (lambda t: t.where("doc % 2 = 0"), lambda t: t.where("doc % 2 <> 0"))]
    counts = rollup.tagged("doc", *halves[0]).union(rollup.tagged("doc", *halves[1]))
    shown = F.array_join(F.transform(F.map_entries("section_types"), lambda x: F.concat(x["key"], F.lit(": "), x["value"])), ", ")
    return rollup.document_statistics(counts).withColumn("types", shown).drop("section_types")


@query(f"""WITH {BASE}, t AS (SELECT doc, name, count(*) AS n FROM held GROUP BY ALL), s AS (SELECT doc, max(r) AS chunks, count(*) FILTER (r IS NOT NULL) + count(*) FILTER (o_orderstatus = 'F') + 2 AS all_chunks FROM own GROUP BY doc)
SELECT t.doc, name AS term, (n + 1) / all_chunks > 0.25 AS ubiquitous FROM t JOIN s USING (doc)""")
def ubiquitous_terms(read):
    """Terms that over a quarter of an agreement's chunks name: its orders, and the definitions once."""
    _, made = agreement(read)
    return _common(made, _chunk_terms(read))


def _chunk_terms(read) -> DataFrame:
    """(doc, chunk_id, term): what texts and tables name, they hold already; chunks of definitions are read for it."""
    defined, made = agreement(read)
    held = made.where("chunk_type <> 'definition'").select("doc", "chunk_id", F.explode("terms").alias("term"))
    own = terms.found_terms(made.where("chunk_type = 'definition'").select("doc", "chunk_id", "text"), defined, "chunk_id", "doc")
    return once(read, "agreement-terms", SOURCES, lambda: written(held.unionByName(own), "chunk-terms"))


def _common(made: DataFrame, named: DataFrame) -> DataFrame:
    total = made.groupBy("doc").agg(F.count(F.lit(1)).alias("total"))
    n = named.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("n"))
    return n.join(total, "doc").select("doc", "term", (F.col("n") / F.col("total") > terms.UBIQUITOUS).alias("ubiquitous"))


@query(f"""WITH {BASE}, hit AS (SELECT * FROM held WHERE r <= 3), asked AS (SELECT doc, min(name) AS name FROM hit GROUP BY doc), s AS (SELECT doc, count(*) + count(*) FILTER (o_orderstatus = 'F') + 2 AS total FROM own GROUP BY doc),
common AS (SELECT doc, name FROM held JOIN s USING (doc) GROUP BY doc, name, total HAVING (count(*) + 1) / total > 0.25), n AS (SELECT doc, name, count(*) AS n FROM hit GROUP BY ALL),
c AS (SELECT lines.doc, lines.name, coalesce(n.n, 0) AS n, lines.name = asked.name AS q, n.n IS NOT NULL AS m, contains(lower(lines.name), 'ring') OR contains(lower(lines.name), split_part(lower(asked.name), ' ', 1)) AND length(split_part(asked.name, ' ', 1)) >= 4 OR contains(lower(lines.name), split_part(lower(asked.name), ' ', 2)) AND length(split_part(asked.name, ' ', 2)) >= 4 AS k, common.name IS NOT NULL AS u
    FROM lines JOIN asked USING (doc) LEFT JOIN n ON n.doc = lines.doc AND n.name = lines.name LEFT JOIN common ON common.doc = lines.doc AND common.name = lines.name),
f AS (SELECT *, CASE WHEN n > 0 THEN log2(n + 1) ELSE 0 END + CASE WHEN q THEN 100 WHEN u THEN -50 ELSE 0 END + CASE WHEN m AND NOT u THEN 3 ELSE 0 END + CASE WHEN k AND NOT q THEN 10 ELSE 0 END AS score FROM c WHERE n > 0 OR q OR k),
p AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY round(score, 6) DESC, length(name) DESC, name) AS rank FROM f), one AS (SELECT doc, name, 0 AS tier, rank, q FROM p WHERE rank <= 12),
rest AS (SELECT doc, name, row_number() OVER (PARTITION BY doc ORDER BY round(score, 6) DESC, length(name) DESC, name) AS rank FROM p WHERE rank > 12 AND m AND NOT u)
SELECT doc AS query_id, name AS term, tier, CAST(rank AS INT) AS rank, q AS in_query FROM one UNION ALL SELECT doc, name, 1, CAST(rank AS INT), false FROM rest WHERE rank <= 6""")
def injected_terms(read):
    """Terms for a question about a part in each agreement, whose hits are the texts of the first three orders."""
    defined, made = agreement(read)
    number = F.substring_index("section_id", ".", -1).try_cast("int")
    hits = made.where((F.col("article_number") == 2) & (F.col("chunk_type") == "text") & (number <= 3)).select(F.col("doc").alias("query_id"), "doc", "chunk_id", "terms")
    first = hits.select("doc", F.explode("terms").alias("term")).groupBy("doc").agg(F.min("term").alias("term"))
    asked = first.select(F.col("doc").alias("query_id"), "doc", F.concat(F.lit("What would you say about the "), "term", F.lit(" and each ring")).alias("query"))
    named = _chunk_terms(read)
    common = _common(made, named).where("ubiquitous").select("doc", "term")
    lookup = injection.definition_chunks(made, "doc")
    scored = written(injection.candidate_terms(asked, hits, named, defined, lookup, common, "doc"), "candidate-terms")
    asked_for = defined.join(scored.select("doc", "term").distinct(), ["doc", "term"], "left_semi")  # what others refer to isn't read
    refs = terms.found_terms(asked_for.select("doc", F.col("term").alias("of"), "text"), defined, "of", "doc").select("doc", F.col("of").alias("term"), F.col("term").alias("ref"))
    return injection.injected_terms(scored, written(refs, "references"), "doc").select("query_id", "term", "tier", "rank", "in_query")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name WHEN s_suppkey % 3 = 1 THEN s_name || ' Holdings' END AS name FROM supplier""")
def borrower_names(read):
    made = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("Overview\nBorrower: "), "s_name", F.lit(" [3] (Preamble, p. 9).\nMore"))).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("BORROWER\n\n  "), "s_name", F.lit(" Holdings [1][2],\nLENDER"))).otherwise("BORROWER: NOT FOUND")
    return read("supplier").select("s_suppkey", A.borrower_name(made).alias("name"))


@query("""SELECT o_orderkey, 'Clause one of ' || o_orderkey || chr(10) || chr(10) || 'Clause two' AS text FROM orders""")
def cleaned_definitions(read):
    made = F.concat(F.lit("  Clause  one of \t"), "o_orderkey", F.lit("\nPowered by BamSEC.com\nPDF page 12\n 47\n\n\nClause\t two "))
    return read("orders").select("o_orderkey", A.clean_definition(made).alias("text"))


@query("""SELECT o_orderkey, o_orderpriority AS a, o_orderstatus AS b, 2 AS n FROM orders""")
def list_codec(read):
    """Lists written as one text and read again."""
    back = A.split_list(A.joined_list(F.array("o_orderpriority", "o_orderstatus")))
    return read("orders").select("o_orderkey", F.get(back, 0).alias("a"), F.get(back, 1).alias("b"), F.size(back).alias("n"))


@query("SELECT p_partkey, CAST(p_size AS INT) AS number FROM part")
def article_numbers(read):
    """Sizes written as Roman numerals and read again."""
    tens, ones = F.array(*map(F.lit, ("", "X", "XX", "XXX", "XL", "L"))), F.array(*map(F.lit, ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX")))
    roman = F.concat(F.get(tens, F.floor(F.col("p_size") / 10).cast("int")), F.get(ones, F.col("p_size") % 10))
    return read("part").select("p_partkey", article_number(roman).alias("number"))
