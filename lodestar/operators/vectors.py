"""Nearest neighbours by cosine, exact: a stated set of queries against all vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators.lexical import EXACT, top_k

#: Rows of a block of queries and of vectors; numbers of a matrix that a task holds at once.
QUERIES, VECTORS, HELD = 2048, 16384, 1 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, z: s + z)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def strips(rows: int, width: int) -> Iterator[slice]:
    """Runs of rows whose product with ``width`` columns has about HELD numbers, so that a task's memory doesn't follow its batch."""
    step = max(1, HELD // max(1, width))
    return (slice(at, min(at + step, rows)) for at in range(0, rows, step))


def unit_rows(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors of length one, a row each, out of an Arrow column of lists of one length."""
    lists = vectors.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    if not len(lists):
        return np.zeros((0, 0))
    if len(np.unique(np.diff(lists.offsets.to_numpy()))) > 1:
        raise ValueError("vectors that are compared have to be of one length")
    m = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def best_of(asked: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score): the k best columns of each row by (1 + cosine) / 2 to EXACT digits, the first of equals; a strip of rows at a time."""
    out = []
    for at in strips(len(asked), len(own)):
        score = (1 + asked[at] @ own.T) / 2
        shown = np.round(score, EXACT)
        last = -np.partition(-shown, k - 1, axis=1)[:, k - 1] if k < len(own) else np.full(len(shown), -np.inf)
        row, column = np.nonzero(~(shown < last[:, None]))
        order = np.lexsort((column, -shown[row, column], row))
        row, column = row[order], column[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        row, column = row[place < k], column[place < k]
        out.append((row + at.start, column, score[row, column]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def nearest(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", digits: int | None = 5) -> DataFrame:
    """(query_id, id, score, rank) of queries (query_id, vector, [label]): the k vectors of the largest (1 + cosine) / 2.

    With a ``label`` in the queries only vectors of that label are compared: the filter comes before the scores. A task multiplies a
    block of queries with a block of vectors and keeps k of each query; blocks have at most about QUERIES and VECTORS rows,
    so their number follows the tables and nothing is broadcast, and scores are made for a strip of queries at a time. Null vectors and such of length zero match nothing. Scores are
    shown to ``digits``; with None all that blocks found is given, unranked and unrounded: k or more of each query.
    """
    label = "label" if "label" in queries.columns else None
    own = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), (F.col(label) if label else F.lit(0)).alias("label"))
    asked = queries.select(F.col("query_id").alias("id"), F.col("vector").cast("array<double>").alias("v"), (F.col(label) if label else F.lit(0)).alias("label"))
    filled = F.col("label").isNotNull() & F.exists("v", lambda x: x != 0)
    own, asked = own.where(filled), asked.where(filled)
    blocks = lambda frame, size, name: frame.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    sizes = blocks(own, VECTORS, "n_own").join(blocks(asked, QUERIES, "n_asked"), "label")
    dealt = lambda frame, mine, other: frame.join(sizes, "label").select(
        "label", "id", "v", F.pmod(F.xxhash64("id"), mine).cast("int").alias(mine), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other)
    )
    keys = ["label", "n_own", "n_asked"]
    kind, query_kind = own.schema["id"].dataType.simpleString(), asked.schema["id"].dataType.simpleString()

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("id")
        theirs, mine = unit_rows(left["v"]), unit_rows(right["v"])
        rows, columns, scores = best_of(mine, theirs, k) if len(left) and len(right) else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": right["id"].take(pa.array(rows)), "id": left["id"].take(pa.array(columns)), "score": pa.array(scores)})

    pairs = dealt(own, "n_own", "n_asked").groupBy(*keys).cogroup(dealt(asked, "n_asked", "n_own").groupBy(*keys)).applyInArrow(compare, f"query_id {query_kind}, id {kind}, score double")
    pairs = pairs.withColumnRenamed("id", id_col)
    return pairs if digits is None else top_k(pairs, k, id_col, digits)
