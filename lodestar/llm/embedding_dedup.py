"""Embedding near-duplicates: products of int8 tiles with rigorous error bounds; pairs they can't decide are computed in double precision.

A unit vector u is kept as s * q + e: q has int8 entries, s is the largest entry's size over 127, e is what is lost, and its
length d = |e| is known. For two vectors |u.v - s_u s_v q_u.q_v| <= |e_u||s_v q_v| + |s_u q_u||e_v| + |e_u||e_v|, and
|s q| <= 1 + d, which gives d_u (1 + d_v) + d_v (1 + d_u) + d_u d_v.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import by_group, forest, stored
from lodestar.llm.components import components

#: Vectors in a block; a task compares two blocks. Rows of a block that are multiplied at a time.
BLOCK, ROWS = 2048, 256
#: Slack for roundings of the bound itself and of single precision.
SLACK = 1e-5


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scales, lengths of the errors) of the vectors' directions."""
    unit = vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    lost = unit - codes * scale[:, None]
    return codes, scale, np.sqrt(np.einsum("ij,ij->i", lost, lost))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    return np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))


def linked_pairs(x: np.ndarray, y: np.ndarray | None, threshold: float):
    """Blocks of (i, j) with cosine(x[i], y[j]) >= threshold; with y None, i < j within x."""
    qx, sx, dx = quantise(x)
    qy, sy, dy = (qx, sx, dx) if y is None else quantise(y)
    exact = np.float32 if x.shape[1] <= 1024 else np.float64  # sums of products of int8 codes are exact in these
    right, other = qy.astype(exact).T, x if y is None else y
    for k in range(0, len(x), ROWS):
        i = slice(k, k + ROWS)
        dot = (qx[i].astype(exact) @ right) * sx[i, None] * sy
        error = dx[i, None] * (1 + dy) + dy * (1 + dx[i, None]) + dx[i, None] * dy + SLACK
        maybe = dot + error >= threshold
        if y is None:
            maybe &= np.arange(k, k + dot.shape[0])[:, None] < np.arange(len(qy))
        a, b = np.nonzero(maybe)
        sure = dot[a, b] - error[a, b] >= threshold
        a += k
        for at in range(0, len(a), 1 << 16):
            p = slice(at, at + (1 << 16))
            keep = sure[p].copy()
            open_ = np.flatnonzero(~keep)
            keep[open_] = cosines(x[a[p][open_]], other[b[p][open_]]) >= threshold
            yield a[p][keep], b[p][keep]


def _tile(key: tuple, rows: pd.DataFrame, threshold: float) -> pd.DataFrame | None:
    """Links of one pair of blocks: for each linked class the vectors it links with, and the smallest class it is tied to here."""
    rows = rows.sort_values(["block", "rep"], kind="stable")
    first = int((rows["block"] == key[-2]).sum())
    vectors = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
    vectors = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])  # by powers of two, so that squares of any lengths fit
    ids, weight = rows["rep"].to_numpy(), rows["n"].to_numpy()
    own = key[-2] == key[-1]
    links = np.zeros(len(rows), np.int64)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    label = np.arange(len(rows))
    for a, b in linked_pairs(vectors, None, threshold) if own else linked_pairs(vectors[:first], vectors[first:], threshold):
        b = b if own else b + first
        np.add.at(links, a, weight[b])
        np.add.at(links, b, weight[a])
        apart = label[a] != label[b]  # what is tied already needs no link more
        if apart.any():
            left.append(a[apart])
            right.append(b[apart])
            label = forest(len(rows), np.concatenate(left), np.concatenate(right))
            tied = np.flatnonzero(label != np.arange(len(rows)))
            left, right = [tied], [label[tied]]
    some = np.flatnonzero(links)
    return pd.DataFrame({"rep": ids[some], "links": links[some], "tied": ids[label[some]]}) if len(some) else None


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Vectors are compared if their labels are equal and not null, and their lengths are equal. Vectors that are null or
    empty, have length zero or hold null or non-finite entries link with nothing, and so do rows with a null id: each of
    these has n_links 0 and its own id as component. Equal vectors are one class and compared once; their links count each
    row. Rows that repeat an id count as vectors of their own; other
    columns are left out, whatever their names. An empty table gives an empty result. A class is dealt to blocks of BLOCK vectors, and each pair of
    blocks of a label is a task's work, so a label with a third of all rows spreads over many tasks.
    """
    base = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("embedding"), F.col(label_col).alias("label"))
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = base.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(finite & F.exists("embedding", lambda x: x != 0))
    hashed = usable.withColumn("h", F.xxhash64("embedding"))
    classes = stored(hashed.groupBy("label", "h", "embedding").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).withColumn("dim", F.size("embedding")), "vector-classes")
    blocks = classes.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = classes.join(blocks, ["label", "dim"]).withColumn("block", F.pmod(F.xxhash64("rep", "h"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tiles = dealt.withColumn("other", other).select("label", "dim", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "n", "embedding")
    rep_type = classes.schema["rep"].dataType.simpleString()
    found = by_group(tiles, ["label", "dim", "i", "j"], lambda key, rows: _tile(key, rows, threshold), f"rep {rep_type}, links long, tied {rep_type}")
    found = stored(found, "vector-links")
    roots = components(found, "rep", "tied")
    per_class = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = classes.select("label", "h", "embedding", "rep", "n").join(per_class, "rep", "left").join(roots, F.col("rep") == roots["id"], "left").select("label", "h", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    same = [hashed["label"] == named["label"], hashed["h"] == named["h"], hashed["embedding"] == named["embedding"]]
    linked = hashed.join(named, same).select("id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    alone = base.where(~F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False)))
    out = linked.union(alone.select("id", F.lit(0).cast("long"), F.col("id")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
