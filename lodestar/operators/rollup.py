"""Statistics of documents in one pass over what was made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGES, SECTIONS, DEFINITIONS, CHUNKS = "page_count", "section_count", "definition_count", "chunk_count"


def tagged(doc_col: str, pages: DataFrame, sections: DataFrame, definitions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc, kind, section_type, n, tables): what was made of documents, counted by document, kind and type. Rows of several such tables
    (of other days, or other parts of a document) can be put together and counted again."""
    none = F.lit(None).cast("string")
    rows = pages.select(F.col(doc_col).alias("doc"), F.lit(PAGES).alias("kind"), none.alias("section_type"), F.lit(0).alias("tables"))
    rows = rows.union(sections.select(doc_col, F.lit(SECTIONS), "section_type", F.coalesce(F.size("tables"), F.lit(0))))
    rows = rows.union(definitions.select(doc_col, F.lit(DEFINITIONS), none, F.lit(0))).union(chunks.select(doc_col, F.lit(CHUNKS), none, F.lit(0)))
    return rows.groupBy("doc", "kind", "section_type").agg(F.count(F.lit(1)).alias("n"), F.sum("tables").alias("tables"))


def document_statistics(counts: DataFrame, doc_col: str = "doc") -> DataFrame:
    """(doc, page_count, section_count, definition_count, chunk_count, table_count, section_types) of rows that ``tagged`` made, once or in
    parts: sections' types are a map sorted by type. A kind that a document lacks counts 0; a null type isn't in the map. Each
    document comes to a few rows before the last shuffle, however many pages and chunks it has."""
    merged = counts.groupBy("doc", "kind", "section_type").agg(F.sum("n").alias("n"), F.sum("tables").alias("tables"))
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).alias(kind)
    typed = F.when((F.col("kind") == SECTIONS) & F.col("section_type").isNotNull(), F.struct("section_type", "n"))
    found = merged.groupBy(F.col("doc").alias(doc_col)).agg(*map(of, (PAGES, SECTIONS, DEFINITIONS, CHUNKS)), F.sum("tables").alias("table_count"), F.array_sort(F.collect_list(typed)).alias("types"))
    return found.withColumn("section_types", F.map_from_entries("types")).drop("types")
