"""Page dumps: text files whose pages end with form feeds, as text extractors write them. Large files are read in blocks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions.text import OCR_CHARS, strip

PAGE_END = "\f"


def write_pages(pages: DataFrame, path: str) -> None:
    """Pages (document, page, text) as one dump a document, in folders ``document=…``, by page and then text. Null texts are empty
    pages; form feeds within a text become blanks, as they would end its page."""
    text = F.translate("text", PAGE_END, " ")
    dealt = pages.repartition("document").sortWithinPartitions("document", "page", "text")
    dealt.select("document", text.alias("value")).write.partitionBy("document").option("lineSep", PAGE_END).text(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, text, needs_ocr) of the dumps in a file, folder or pattern; a path that isn't there is an error.

    Pages count from 1 in each file and keep their line breaks; empty ones count, and an empty file has none. A page with little text
    needs recognition. Spark splits files at blocks of bytes, and a page belongs to the block it starts in. A page's number is its place in
    its block plus the pages of the blocks before: those come from a row for each block, so no file has to be read by one task
    and no text is shuffled for its number.
    """
    found = spark.read.option("lineSep", PAGE_END).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    blocks = found.select("path", "block").mapInArrow(_counted, "path string, block long, n long").groupBy("path", "block").agg(F.sum("n").alias("n"))
    ahead = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("path", "block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    placed = found.mapInArrow(_placed, "path string, block long, value string, place long").join(before, ["path", "block"])
    return placed.select("path", (F.col("before") + F.col("place")).alias("page"), F.col("value").alias("text"), (F.length(strip(F.col("value"))) < OCR_CHARS).alias("needs_ocr"))


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, block, n) of each batch. Going through batches also keeps filters of the result from changing how files are split here alone."""
    for batch in batches:
        n = pa.Table.from_batches([batch]).group_by(["path", "block"]).aggregate([([], "count_all")])
        yield from n.select(["path", "block", "count_all"]).rename_columns(["path", "block", "n"]).to_batches()


def _placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their place, from 1, in their block. A task reads a block's rows one after another."""
    now, seen = None, 0
    for batch in batches:
        places = []
        for key in zip(batch.column("path").to_pylist(), batch.column("block").to_pylist(), strict=True):
            now, seen = (key, seen + 1) if key == now else (key, 1)
            places.append(seen)
        yield pa.RecordBatch.from_arrays([*(pc.cast(c, pa.string()) if pa.types.is_large_string(c.type) else c for c in batch.columns), pa.array(places, pa.int64())], names=[*batch.schema.names, "place"])
