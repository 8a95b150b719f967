"""Blocks of an answer's body: typed lines become tables, lists, fields, headings and paragraphs, by gaps and islands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions.text import line_kind, strip, table_cells

#: What is put before a bullet, a sub-bullet or a number, and is no part of the item.
MARKER = r"^(?:[-*]|[0-9]+\.)[ \t]+"
#: A bullet that is indented by a tab or two blanks stands under the one before.
INDENTED = r"^(?:\t| {2,})[ \t]*[-*][ \t]+"
#: Kinds of lines that make one block as long as they follow each other; a line of any other kind is a block alone.
JOINED = {"table": "table", "separator": "table", "bullet": "list", "sub_bullet": "list", "numbered": "numbered", "paragraph": "paragraph"}


def typed_lines(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line, kind, text): each line of each text with its number and kind. An indented bullet that follows a bullet, or another
    such, is a ``sub_bullet``; anywhere else it is a bullet."""
    lines = texts.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("line", "text"))
    lines = lines.withColumn("kind", line_kind(F.col("text")))
    before = F.lag("kind").over(Window.partitionBy("id").orderBy("line"))
    sub = (F.col("kind") == "bullet") & F.col("text").rlike(INDENTED) & F.coalesce(before == "bullet", F.lit(False))
    return lines.withColumn("kind", F.when(sub, "sub_bullet").otherwise(F.col("kind")))


def blocks(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, block, kind, first_line, n_lines, items): a row for each block of a text, in order.

    Lines of one kind in a row are a block: pipe rows with their rule a ``table``, bullets and sub-bullets a ``list``, numbered
    lines, paragraphs; a heading or a field is one alone. Blank lines end a block and are none. ``items`` are (text, under): the
    cells of a row joined by ``|``, rules left out; a list's items without their marks, a sub-bullet ``under`` the number of the last
    bullet before it, others under null; the stripped lines of all else. Null texts have no block; ids have to be unique.
    """
    joined = F.create_map(*[F.lit(x) for pair in JOINED.items() for x in pair])
    own = Window.partitionBy("id").orderBy("line")
    lines = typed_lines(texts, id_col, text_col).withColumn("of", F.coalesce(joined[F.col("kind")], F.col("kind")))
    starts = F.coalesce(F.lag("of").over(own) != F.col("of"), F.lit(True)) | ~F.col("kind").isin(*JOINED)
    lines = lines.withColumn("starts", starts & (F.col("of") != "blank")).withColumn("block", F.sum(F.col("starts").cast("int")).over(own)).where("of <> 'blank'")
    within = Window.partitionBy("id", "block").orderBy("line")
    bullet = F.sum((F.col("kind") == "bullet").cast("int")).over(within)
    body = F.when(F.col("of") == "table", F.array_join(table_cells(F.col("text")), "|")).when(F.col("of").isin("list", "numbered"), F.regexp_replace(strip(F.col("text")), MARKER, "")).otherwise(strip(F.col("text")))
    lines = lines.select("id", "block", "line", "kind", "of", F.struct(body.alias("text"), F.when(F.col("kind") == "sub_bullet", bullet).alias("under")).alias("item"))
    item = F.when(F.col("kind") != "separator", F.struct("line", "item"))
    grouped = lines.groupBy("id", "block", F.col("of").alias("kind")).agg(F.min("line").alias("first_line"), F.count(F.lit(1)).alias("n_lines"), F.array_sort(F.collect_list(item)).alias("items"))
    return grouped.select(F.col("id").alias(id_col), "block", "kind", "first_line", "n_lines", F.transform("items", lambda x: x["item"]).alias("items"))
