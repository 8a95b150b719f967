"""Defined terms in texts: finding, sub-terms, frequencies and scores."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# A term in more than this share of texts is ubiquitous; weights of a term's score.
UBIQUITOUS = 0.25
IN_QUERY, COMMON, METADATA, KEYWORD, LONG = 100, -50, 3, 10, 15
LONG_DEFINITION = 800
WORD_BREAK = r"(?U)\W+"
WORD_CHAR = regex.compile(r"\w")
#: Characters of a term that others are joined on.
GRAM = 3
#: Characters of terms that are sent to each executor at most; automata of groups that a task keeps.
DICTIONARY, AUTOMATA = 1 << 21, 64


def found_terms(texts: DataFrame, terms: DataFrame, id_col: str, by: str | None = None) -> DataFrame:
    """(id, term): terms that a text (id, text) names, and the terms that stand inside those.

    Terms are sought from left to right between word borders, the longest first; what is found is consumed, and case counts. With ``by``
    terms (by, term) belong to groups, and a text (by, id, text) is read for the terms of its group; texts of a null group name none.
    A null text names none, nor do null and empty terms; a text whose id is null keeps it.
    """
    keys = [by] if by else []
    own = terms.select(*keys, "term").where("term <> ''").distinct()
    if by:
        lists = own.groupBy(by).agg(F.collect_list("term").alias("_terms"))
        return sought(texts.join(lists, by).select(by, id_col, "text", "_terms"), None, True, True, by).distinct()
    known = dictionary(own)
    if known is not None:
        return sought(texts.select(id_col, "text"), known, True, True).distinct()
    hits = sought(_with_near(texts, own, id_col), None, True, False)
    return hits.union(hits.join(sub_terms(own), "term").select(id_col, F.col("sub_term").alias("term"))).distinct()


def held_phrases(texts: DataFrame, terms: DataFrame, id_col: str) -> DataFrame:
    """(id, term) in lower case of the terms that a text (id, text) holds between word borders, whatever the case."""
    own = terms.select(F.lower("term").alias("term")).where("term <> ''").distinct()
    lower = texts.select(id_col, F.lower("text").alias("text"))
    known = dictionary(own)
    return sought(lower if known is not None else _with_near(lower, own, id_col), known, False, False).distinct()


def dictionary(terms: DataFrame) -> list[str] | None:
    """All terms, if they have at most DICTIONARY characters, counted first; None if they have more."""
    size = terms.agg(F.sum(F.length("term") + 1).alias("n")).first().n or 0
    return sorted(r.term for r in terms.collect()) if size <= DICTIONARY else None


def sought(texts: DataFrame, known: list[str] | None, consume: bool, inside: bool, by: str | None = None) -> DataFrame:
    """The columns of ``texts`` before ``text`` and ``term``, a row for each different term of a text: of ``known``, which goes to each
    executor once, or of the text's own list ``_terms``. ``inside`` adds the terms inside those found.

    Texts are read where they are, in Arrow batches, in one walk over an automaton of the terms, so their number costs nothing. Of
    lists that come again the last few automata are kept; those of groups ``by`` are known by their group and not read for each text.
    """
    keep = texts.columns[: texts.columns.index("text")]
    names = [*keep, "term"]
    schema = ", ".join([*(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in keep), "term string"])
    shared = None if known is None else texts.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = Automaton(shared.value) if shared else None
        made: dict[object, Automaton] = {}
        for batch in batches:
            row, hits = [], []
            groups = batch.column(by).to_pylist() if by else None
            for k, text in enumerate(batch.column("text")):
                text = text.as_py()
                if not text:
                    continue
                own = every
                if own is None:
                    key = groups[k] if by else tuple(batch.column("_terms")[k].as_py())
                    if key not in made:
                        if len(made) >= AUTOMATA:
                            made.clear()
                        made[key] = Automaton(batch.column("_terms")[k].as_py() if by else key)
                    own = made[key]
                found = own.named(text, consume)
                found = own.with_inner(found) if inside else found
                row += [k] * len(found)
                hits += found
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in keep), pa.array(hits, pa.string())], names=names)

    return texts.mapInArrow(run, schema)


def named_terms(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` (by, text, terms, _terms, ...) without ``_terms``: where ``terms`` is null it becomes the terms that the text names, of the
    list ``_terms`` of its group ``by``, the longest first. Rows stay where they are, and no row is made for a term."""
    names = [c for c in rows.columns if c != "_terms"]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[object, Automaton] = {}
        for batch in batches:
            held, lists, out = batch.column("terms"), batch.column("_terms"), []
            for k, (group, text) in enumerate(zip(batch.column(by).to_pylist(), batch.column("text").to_pylist(), strict=True)):
                if held[k].is_valid:
                    out.append(held[k].as_py())
                    continue
                if not text or not lists[k].is_valid:
                    out.append([])
                    continue
                if group not in made:
                    if len(made) >= AUTOMATA:
                        made.clear()
                    made[group] = Automaton(lists[k].as_py())
                found = made[group].with_inner(made[group].named(text, True))
                out.append(sorted(found, key=lambda t: (-len(t), t)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string())) if c == "terms" else batch.column(c) for c in names], names=names)

    return rows.mapInArrow(run, schema)


class Automaton:
    """Finds all of a set of terms in one pass over a text."""

    def __init__(self, terms: Iterable[str]):
        self.tree = ahocorasick.Automaton()
        for t in terms:
            self.tree.add_word(t, t)
        self.tree.make_automaton()
        self.empty = len(self.tree) == 0

    def named(self, text: str, consume: bool) -> set[str]:
        """Terms between word borders; with ``consume`` the leftmost longest that don't overlap."""
        if self.empty:
            return set()
        out: set[str] = set()
        longest: dict[int, str] = {}
        for last, term in self.tree.iter(text):
            start = last + 1 - len(term)
            if border(text, start) and border(text, last + 1):
                if consume:
                    longest[start] = term  # ends rise, so the longest of a start comes last
                else:
                    out.add(term)
        end = 0
        for start in sorted(longest):
            if start >= end:
                out.add(longest[start])
                end = start + len(longest[start])
        return out

    def with_inner(self, terms: set[str]) -> set[str]:
        """Those terms, and the ones that stand anywhere inside them."""
        return terms.union(*({t for _, t in self.tree.iter(term)} for term in terms))


@lru_cache(1 << 16)
def in_word(char: str) -> bool:
    """Letters with their marks, decimal digits, connectors and joiners make up words."""
    return WORD_CHAR.match(char) is not None


def border(text: str, at: int) -> bool:
    return (at > 0 and in_word(text[at - 1])) != (at < len(text) and in_word(text[at]))


def _with_near(texts: DataFrame, terms: DataFrame, id_col: str) -> DataFrame:
    """(id, text, _terms): texts with the terms they may hold, where a dictionary is too large for each executor: an equi-join on
    a term's longest word, or on the first character of a term without words."""
    sized = F.transform(F.split("term", WORD_BREAK), lambda x: F.struct(F.length(x).alias("n"), x.alias("w")))
    longest = F.array_max(sized)["w"]
    marks = F.split(F.regexp_replace("text", r"(?U)\w+", ""), "")
    words = texts.select(F.col(id_col).alias("_id"), F.explode(F.array_distinct(F.concat(F.split("text", WORD_BREAK), marks))).alias("word")).where("word <> ''").distinct()
    near = words.join(terms.withColumn("word", F.when(longest == "", F.substring("term", 1, 1)).otherwise(longest)), "word")
    lists = near.groupBy("_id").agg(F.array_sort(F.collect_set("term")).alias("_terms"))
    return texts.join(lists, F.col(id_col).eqNullSafe(F.col("_id"))).select(id_col, "text", "_terms")


def at_borders(term: Column) -> Column:
    """A pattern that finds the term between word borders."""
    return F.concat(F.lit(r"(?U)\b"), F.regexp_replace(term, r"([^\p{L}\p{N}_])", r"\\$1"), F.lit(r"\b"))


def sub_terms(terms: DataFrame, by: str | None = None) -> DataFrame:
    """([by], term, sub_term): terms that stand anywhere inside another (of the same group). A term's first characters, up to GRAM, are
    joined with all grams of the others, so candidates come from an equi-join and not from all pairs."""
    keys = [by] if by else []
    own = terms.select(*keys, "term").where("term <> ''").distinct()
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("term") - n + 1, F.lit(1))), lambda k: F.substring("term", k, n))))
    whole = own.select(*keys, "term", F.explode(F.array_distinct(grams)).alias("gram"))
    first = own.select(*keys, F.col("term").alias("sub_term"), F.substring("term", 1, GRAM).alias("gram"))
    return whole.join(first, [*keys, "gram"]).where((F.col("term") != F.col("sub_term")) & F.contains("term", "sub_term")).select(*keys, "term", "sub_term").distinct()


def document_frequency(found: DataFrame, total: DataFrame) -> DataFrame:
    """(term, n, share, ubiquitous) over hits (id, term) and a one-row ``total`` (n_texts)."""
    counted = found.groupBy("term").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total))
    share = F.col("n") / F.col("n_texts")
    return counted.select("term", "n", F.round(share, 6).alias("share"), (share > UBIQUITOUS).alias("ubiquitous"))


def term_scores(terms: DataFrame) -> DataFrame:
    """``score`` of terms (n, in_query, ubiquitous, metadata, keyword, length)."""
    n, rare = F.col("n"), ~F.col("ubiquitous")
    base = F.when(n > 0, F.log2(n + 1)).otherwise(0.0)
    score = (
        base + F.when(F.col("in_query"), IN_QUERY).when(F.col("ubiquitous"), COMMON).otherwise(0) + F.when(F.col("metadata") & rare, METADATA).otherwise(0)
        + F.when(F.col("keyword") & ~F.col("in_query"), KEYWORD).otherwise(0) + F.when((F.col("length") > LONG_DEFINITION) & rare & (n > 0), LONG).otherwise(0)
    )
    return terms.withColumn("score", F.round(score, 6))


def first_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def filter_definitions(definitions: DataFrame, query: str) -> DataFrame:
    """Definitions (term, text) that hold the query in either, whatever the case; all for a blank query; by term."""
    q = F.lower(F.lit(query.strip()))
    return definitions.where(F.contains(F.lower("term"), q) | F.contains(F.lower("text"), q)).orderBy("term")


def page_of(definitions: DataFrame, page: int, per_page: int = 20) -> DataFrame:
    return definitions.orderBy("term").offset((page - 1) * per_page).limit(per_page)
