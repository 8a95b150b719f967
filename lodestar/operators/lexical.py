"""BM25Plus over a posting table, for many queries in one plan."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions.text import EDGE_MARKS, tokenize

# Saturation, length weight and the floor of a match.
K1, B, DELTA = 1.2, 0.5, 1.0
#: Digits to which scores are compared.
EXACT = 11
#: Parts of a summand: multiples of this add up without rounding as long as sums stay below 2 ** 53 of them (8,192).
FINE = 2.0**-40
#: Queries and documents of a block.
QUERIES, DOCS = 1024, 2048
#: Texts that are counted together; what separates pieces.
ROWS, BLANKS = 200, re.compile(r"[ \t\n\x0b\f\r]+")
#: From a piece's first character that isn't an edge mark to its end.
TOKEN = rf"[^\s{re.escape(EDGE_MARKS)}]\S*"


class Index:
    """Postings (id, token, tf, dl) and one row of statistics (n_docs, avgdl) of a corpus."""

    def __init__(self, postings: DataFrame, stats: DataFrame, id_col: str):
        self.postings, self.stats, self.id_col = postings, stats, id_col

    def tables(self) -> list[DataFrame]:
        return [self.postings, self.stats]

    def write(self, path: str) -> Index:
        """The index as stored tables: later questions read postings and tokenise nothing. Replaces what is there."""
        self.postings.write.mode("overwrite").parquet(f"{path}/postings")
        self.stats.write.mode("overwrite").parquet(f"{path}/stats")
        return read_index(self.postings.sparkSession, path, self.id_col)


def read_index(spark: SparkSession, path: str, id_col: str = "doc_id") -> Index:
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.schema("n_docs long, avgdl double").parquet(f"{path}/stats"), id_col)


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    return Index(counted(docs, id_col, text_col), corpus_stats(docs, id_col, text_col), id_col)


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, token, dl, tf) of each document, counted in Arrow batches where the text is read: no row for an occurrence, and no shuffle."""
    source = docs.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("text")).where("text IS NOT NULL")
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):  # long texts make many rows
                part = batch.slice(at, ROWS)
                found = [Counter(filter(None, (w.strip(EDGE_MARKS) for w in BLANKS.split(t)))) for t in part.column(1).to_pylist()]
                row = np.repeat(np.arange(len(found)), [len(c) for c in found])
                length = np.array([sum(c.values()) for c in found], np.int32)
                tokens, counts = [w for c in found for w in c], [n for c in found for n in c.values()]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(tokens, pa.string()), pa.array(length[row]), pa.array(counts, pa.int64())], names=[id_col, "token", "dl", "tf"])

    return source.mapInArrow(run, f"`{id_col}` {kind}, token string, dl int, tf long")


def token_number(text: Column) -> Column:
    """The number of tokens: pieces between blanks with a character that isn't cut off at edges."""
    return F.regexp_count(F.lower(text), F.lit(TOKEN))


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, token, tf): the term frequencies of each document."""
    return index(docs, id_col, text_col).postings.drop("dl")


def lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(id_col, token_number(F.coalesce(F.col(text_col), F.lit(""))).alias("dl"))


def corpus_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row: documents and their mean length."""
    return lengths(docs, id_col, text_col).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))


def steady_sum(value: Column) -> Column:
    """The sum of doubles in whatever order they come: coarse parts add up exactly, and what rounding leaves of fine ones lies far below a
    double's last digit. So equal texts have equal scores, and their ties go to the smaller id."""
    coarse = F.rint(value / FINE) * FINE
    return F.sum(coarse) + F.sum(value - coarse)


def scores(queries: DataFrame, docs: DataFrame | Index, id_col: str = "doc_id", text_col: str = "text", only: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score) of queries (query_id, query): BM25Plus with idf ln((N + 1) / df), over documents or a stored index.

    Each document gets DELTA * idf of every query token the corpus has, found or not. That part is one number a query, so only
    documents that hold a query token are joined; others have the query's floor and are not listed. Repeated query
    tokens count repeatedly. ``only`` (id) names the documents that are listed; scores stay those of the whole corpus. Postings are cut to the queries' tokens by a semi-join before anything else.
    """
    of = docs if isinstance(docs, Index) else index(docs, id_col, text_col)
    weighed, weight = _weights(_asked(queries), of, only)
    floor = weighed.groupBy("query_id").agg((steady_sum(F.col("w")) * DELTA).alias("floor"))
    part = weight.join(weighed, "token").groupBy("query_id", of.id_col).agg(steady_sum(F.col("w") * F.col("weight")).alias("gain"))
    return part.join(floor, "query_id").select("query_id", of.id_col, (F.col("floor") + F.col("gain")).alias("score"))


def _asked(queries: DataFrame) -> DataFrame:
    """(query_id, token, qtf) of queries (query_id, query)."""
    return queries.select("query_id", F.explode(tokenize(F.col("query"))).alias("token")).groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("qtf"))


def _weights(asked: DataFrame, of: Index, only: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(query_id, token, w) of the queries' tokens that the corpus has, and (id, token, weight) of the listed postings with such a token."""
    found = of.postings.join(asked.select("token").distinct(), "token", "left_semi")
    stats = F.broadcast(of.stats)  # one row
    idf = found.groupBy("token").agg(F.count(F.lit(1)).alias("df")).crossJoin(stats).select("token", F.log((F.col("n_docs") + 1) / F.col("df")).alias("idf"))
    weighed = asked.join(idf, "token").select("query_id", "token", (F.col("qtf") * F.col("idf")).alias("w"))
    tf, norm = F.col("tf"), 1 - B + B * F.col("dl") / F.col("avgdl")
    listed = found if only is None else found.join(only.select(of.id_col).distinct(), of.id_col, "left_semi")
    return weighed, listed.crossJoin(stats).select(of.id_col, "token", (tf * (K1 + 1) / (K1 * norm + tf)).alias("weight"))


def best(queries: DataFrame, docs: DataFrame | Index, k: int, id_col: str = "doc_id", text_col: str = "text", only: DataFrame | None = None, digits: int = 6) -> DataFrame:
    """(query_id, id, score, rank): ``top_k`` of ``scores``, without a row for each query and document that share a token.

    Blocks of about QUERIES queries and DOCS documents meet in a cogroup, where sums are held as a matrix, and each gives the few
    rows of a query that can be among its k best. So rows follow the postings of the queries' tokens and the number of blocks.
    """
    of = docs if isinstance(docs, Index) else index(docs, id_col, text_col)
    id_col = of.id_col
    asked = _asked(queries)
    weighed, weight = _weights(asked, of, only)
    number = lambda n, size: F.greatest(F.ceil(F.col(n) / size), F.lit(1)).cast("int")
    sizes = asked.agg(F.count_distinct("query_id").alias("n")).select(number("n", QUERIES).alias("rows"))
    sizes = F.broadcast(sizes.crossJoin(of.stats.select(number("n_docs", DOCS).alias("columns"))))  # one row
    row, column = F.pmod(F.xxhash64("query_id"), "rows").cast("int").alias("row"), F.pmod(F.xxhash64(id_col), "columns").cast("int").alias("column")
    rows = asked.crossJoin(sizes).select("token", row).distinct()
    theirs = weight.crossJoin(sizes).select("token", F.col(id_col).alias("id"), "weight", column).join(rows, "token")
    mine = weighed.where("query_id IS NOT NULL").crossJoin(sizes).select("query_id", "token", "w", row, F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("column"))
    kind, query_kind = theirs.schema["id"].dataType.simpleString(), mine.schema["query_id"].dataType.simpleString()

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        return best_of_block(left, right, k)

    pairs = theirs.groupBy("row", "column").cogroup(mine.groupBy("row", "column")).applyInArrow(compare, f"query_id {query_kind}, id {kind}, score double")
    return top_k(pairs.withColumnRenamed("id", id_col), k, id_col, digits)


def _numbered(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The different values of a column in their order, null first, and each row's place among them. Structs come as they are met."""
    if pa.types.is_struct(column.type):
        column = column.cast(pa.struct([pa.field(f.name, f.type) for f in column.type])).combine_chunks()
        column = pa.chunked_array([column]).chunk(0)
        first: dict[tuple, int] = {}
        place = np.array([first.setdefault(tuple(x.values()), len(first)) for x in column.to_pylist()], np.int64)
        return column.take(pa.array(np.unique(place, return_index=True)[1])), place
    coded = pa.chunked_array([column.combine_chunks()]).chunk(0).dictionary_encode(null_encoding="encode")
    order = pc.sort_indices(coded.dictionary, null_placement="at_start")
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    return coded.dictionary.take(order), place[coded.indices.to_numpy(zero_copy_only=False)]


def best_of_block(docs: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """(query_id, id, score) of documents (id, token, weight) and queries (query_id, token, w): of each query the documents that can be
    among its k best to EXACT digits. Sums are steady, as in ``steady_sum``."""
    if not len(docs) or not len(asked):
        return pa.table({"query_id": _numbered(asked["query_id"])[0].slice(0, 0), "id": docs["id"].slice(0, 0), "score": pa.array([], pa.float64())})
    ids, doc = _numbered(docs["id"])
    queries, query = _numbered(asked["query_id"])
    tokens, token = _numbered(asked["token"])
    held = pc.index_in(docs["token"].combine_chunks(), tokens).to_numpy(zero_copy_only=False)
    order = np.lexsort((doc, held))
    doc, held, weight = doc[order], held[order], docs["weight"].to_numpy()[order]
    # an id that comes again with a token is added apart
    new = np.append(True, (held[1:] != held[:-1]) | (doc[1:] != doc[:-1]))
    again = np.arange(len(new)) - np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    order = np.lexsort((doc, again, held))
    doc, held, weight, again = doc[order], held[order], weight[order], again[order]
    cuts = np.flatnonzero(np.append(True, (held[1:] != held[:-1]) | (again[1:] != again[:-1])))
    order = np.argsort(token, kind="stable")
    query, token, w = query[order], token[order], asked["w"].to_numpy()[order]
    coarse, fine = np.zeros((len(queries), len(ids))), np.zeros((len(queries), len(ids)))
    starts, ends = np.searchsorted(token, held[cuts]), np.searchsorted(token, held[cuts], "right")
    for a, b, x, y in zip(cuts.tolist(), np.append(cuts[1:], len(held)).tolist(), starts.tolist(), ends.tolist(), strict=True):
        value = w[x:y, None] * weight[None, a:b]
        part = np.rint(value / FINE) * FINE
        at = np.ix_(query[x:y], doc[a:b])
        coarse[at] += part
        fine[at] += value - part
    part = np.rint(w / FINE) * FINE
    floor = (np.bincount(query, part, len(queries)) + np.bincount(query, w - part, len(queries))) * DELTA
    gain = coarse + fine
    score = np.where(gain > 0, floor[:, None] + gain, -np.inf)
    last = -np.partition(-score, k - 1, axis=1)[:, k - 1] if k < len(ids) else np.full(len(score), -np.inf)
    row, column = np.nonzero((gain > 0) & (score >= last[:, None] - 2 * 10.0**-EXACT))
    found = score[row, column]
    order = np.lexsort((column, -found, row))
    row, column, found = row[order], column[order], found[order]
    # of equal scores no more than k, those of the smaller ids
    new = np.append(True, (row[1:] != row[:-1]) | (found[1:] != found[:-1]))[: len(row)]
    kept = np.arange(len(row)) - np.maximum.accumulate(np.where(new, np.arange(len(row)), 0)) < k
    return pa.table({"query_id": queries.take(pa.array(row[kept])), "id": ids.take(pa.array(column[kept])), "score": pa.array(found[kept])})


def sections_of(types: DataFrame, only: str | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Rows of one section type of ``types`` (id, section_type), or, if none is named, of all but some."""
    return types.where(F.col("section_type") == only) if only is not None else types.where(~F.col("section_type").isin(*exclude))


def in_sections(scored: DataFrame, types: DataFrame, only: str | None = None, exclude: tuple[str, ...] = (), id_col: str = "doc_id") -> DataFrame:
    """Scored documents of ``sections_of``. Scores stay those of the whole corpus."""
    return scored.join(sections_of(types, only, exclude).select(id_col), id_col, "left_semi")


def top_k(scored: DataFrame, k: int, id_col: str = "doc_id", digits: int = 6) -> DataFrame:
    """The k best of each query, best first; ties go to the smaller id. Scores are compared to EXACT digits, so that sums in another order
    rank alike, and shown to ``digits``. Spark keeps k rows per query and task before the shuffle."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", EXACT)), id_col))
    return scored.withColumn("rank", place).where(F.col("rank") <= k).withColumn("score", F.round("score", digits))
