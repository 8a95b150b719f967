"""MinHash near-duplicates with tensored banding; candidates are verified on whole shingle sets.

Two small collections of ``tables`` half keys of ``rows`` min-hashes each make tables x tables table keys: key (i, j) joins
half i of the first with half j of the second. That takes 2 * rows * tables min-hashes instead of 2 * rows * tables ** 2. A pair of
similarity s shares a table unless all halves of one collection differ: at most 2 * (1 - s ** rows) ** tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm.common import by_group, forest, list_array, small_batches, stored
from lodestar.llm.components import components
from lodestar.llm.shingles import min_hashes, mix, odd_factors, set_name, shingle_set

#: A pair just at the threshold is missed with at most this probability.
MISSED = 5e-6
#: Documents in a block; a task verifies two blocks of a cluster. Shingles that are compared at a time.
BLOCK, COLUMNS = 256, 8192
SEED = 20


def banding(percent: int, rows: int | None = None) -> tuple[int, int]:
    """(rows, tables): min-hashes of a half key, and half keys of a collection."""
    rows = rows or (3 if percent >= 85 else 2)
    return rows, math.ceil(math.log(MISSED / 2) / math.log(1 - (percent / 100) ** rows))


def signatures(docs: DataFrame, words: int, rows: int, tables: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, name of the set, 2 * tables half keys) of each row; an empty set has no half keys."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = odd_factors(2 * rows * tables, SEED)
        for batch in batches:
            count, names, halves = [], [], []
            for text in batch.column(1):
                found = shingle_set(text.as_py(), words)
                count.append(len(found))
                names.append(set_name(found))
                key = np.zeros(0, np.uint64)
                if len(found):
                    least = min_hashes(found, factors).reshape(2 * tables, rows)
                    key = np.arange(2 * tables, dtype=np.uint64)
                    for k in range(rows):
                        key = mix(key * np.uint64(3) + least[:, k])
                halves.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(names, pa.binary()), list_array(halves, pa.int64())], names=["id", "n_shingles", "name", "halves"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, n_shingles long, name binary, halves array<long>")


def candidates(classes: DataFrame, tables: int) -> DataFrame:
    """(a, b): each class of a table's bucket with the bucket's smallest; every bucket becomes a star, whatever its size."""
    keys = f"flatten(transform(slice(halves, 1, {tables}), (x, i) -> transform(slice(halves, {tables + 1}, {tables}), (y, j) -> xxhash64(x, y, i, j))))"
    placed = classes.select("id", F.explode(F.expr(keys)).alias("key"))
    least = F.expr("min(id) OVER (PARTITION BY key)")
    return placed.select("id", least.alias("a")).where("id <> a").select("a", F.col("id").alias("b")).distinct()


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of a tile, by products of blocks of columns; shingles of a single set are left out."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[code] > 1
    code, owner = code[shared], owner[shared]
    dense = np.cumsum(count > 1) - 1
    code = dense[code]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS):
        a, b = np.searchsorted(code, [start, start + COLUMNS])
        grid = np.zeros((len(sets), min(COLUMNS, int(code[b - 1]) + 1 - start)), np.float32)
        grid[owner[a:b], code[a:b] - start] = 1
        out += grid @ grid.T
    return out


def _verify(rows: pd.DataFrame, words: int, percent: int) -> pd.DataFrame | None:
    sets, ids = [], []
    for row in rows.itertuples():
        found = shingle_set(row.text, words)
        if set_name(found) == row.name:
            sets.append(found)
            ids.append(row.id)
    if len(sets) < 2:
        return None
    both = overlaps(sets).astype(np.int64)
    size = np.array([len(s) for s in sets])
    a, b = np.nonzero(np.triu(100 * both >= percent * (size[:, None] + size - both), 1))
    if not len(a):
        return None
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    label = forest(len(ids), place[a], place[b])
    tied = np.flatnonzero(label != np.arange(len(ids)))
    ids = np.asarray(ids)[order]
    return pd.DataFrame({"a": ids[label[tied]], "b": ids[tied]})


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, rows: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id (the smallest id reachable over links), kept (whether that is its own).

    Documents are linked if 100 * |intersection| >= percent * |union| of their sets of ``words``-word shingles. A text with
    fewer words is one shingle; a text without words, or null, has an empty set and links with nothing. Rows with a null id
    link with nothing and are kept with a null component; rows that repeat an id share its component. Texts of any length are taken
    whole; other columns are left out, whatever their names. An empty table gives an empty result.

    Equal sets are one class, found by a combining aggregation. Buckets of the tables tie classes to clusters; all pairs of a
    cluster are verified on whole sets, by tasks of two blocks of at most about BLOCK documents. A task gives ties that span
    what it has linked, never all pairs, so no pair of a large group is written out.
    """
    rows, tables = banding(percent, rows)
    signed = stored(signatures(docs, words, rows, tables, id_col, text_col), "signatures")
    filled = signed.where(F.col("id").isNotNull() & (F.col("n_shingles") > 0))
    reps = filled.groupBy("name").agg(F.min("id").alias("rep"))
    classes = filled.join(reps.withColumnRenamed("name", "rep_name"), (F.col("name") == F.col("rep_name")) & (F.col("id") == F.col("rep"))).select("id", "name", "halves").dropDuplicates(["id", "name"])
    clusters = components(candidates(classes, tables))
    members = stored(clusters.select("id", F.col("component").alias("cluster")).union(clusters.select("component", "component").distinct()), "clusters")
    blocks = members.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    named = dealt.join(classes.select("id", "name"), "id")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    tiles = named.join(texts, "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "name", "text")
    kind = signed.schema["id"].dataType.simpleString()
    links = by_group(tiles, ["cluster", "i", "j"], lambda key, rows: _verify(rows, words, percent), f"a {kind}, b {kind}")
    equal = filled.join(reps, "name").where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    roots = components(links.union(equal)).withColumnRenamed("id", "member")
    out = signed.select("id", "n_shingles").join(roots, F.col("id") == F.col("member"), "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id"), F.col("component").isNull().alias("kept"))


def keep_first(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, the one of the smallest id; all columns stay.

    Of rows that repeat an id and a text one stays. Rows with a null id all stay.
    """
    ids = near_duplicates(docs, words, percent, None, id_col, text_col).where("kept").select(F.col(id_col).alias("_kept_id")).where("_kept_id IS NOT NULL").distinct()
    mark = "_nth" + "_" * max(map(len, docs.columns))
    nth = F.row_number().over(Window.partitionBy(id_col, F.xxhash64(text_col)).orderBy(F.lit(0)))
    once = docs.join(ids, docs[id_col] == ids["_kept_id"], "left_semi").withColumn(mark, nth).where(F.col(mark) == 1).drop(mark)
    return once.unionByName(docs.where(F.col(id_col).isNull()))
