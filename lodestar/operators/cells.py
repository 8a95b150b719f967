"""Approximate and exact neighbours by a stored index of k-means cells.

Centres are trained on a bounded sample; all vectors are stored by the cell of their nearest centre. A question looks at its nearest cells alone, as
many as a calibration on the sample found enough for the wanted recall. Each cell keeps the largest angle of a vector
from its centre, so a bound on what a cell can hold turns the approximate search into an exact one: cells that
can't hold anything better than what was found are left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.lexical import top_k
from lodestar.operators.vectors import nearest, strips
from lodestar.sources.store import written

#: The training sample has at most so many vectors a cell, and in all; cells grow with the root of the number of vectors, up to MOST.
PER_CELL, SAMPLE, MOST = 64, 65_536, 4096
#: Rounds of k-means; vectors of the sample that calibrate the probes; what these must reach so that RECALL is kept on other questions.
LLOYD, TRIED, RECALL, MARGIN = 15, 512, 0.95, 0.02
SEED = 5
#: Slack of angles for rounding.
SLACK = 1e-7


def unit(x: np.ndarray) -> np.ndarray:
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])  # by powers of two, so that squares fit
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def centres_of(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centres of spherical k-means; a cell that stays empty takes the vector furthest from its centre."""
    random = np.random.default_rng(SEED)
    centres = sample[random.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(LLOYD):
        near = sample @ centres.T
        own, best = near.argmax(axis=1), near.max(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.einsum("ij,ij->i", sums, sums) < 1e-12)
        sums[empty] = sample[np.argsort(best, kind="stable")[: len(empty)]]
        centres = unit(sums)
    return centres


def probes_for(sample: np.ndarray, centres: np.ndarray, k: int, recall: float) -> int:
    """The number of nearest cells that hold the wanted share of the k nearest vectors of a part of the sample, by brute force there.
    Neighbours in all vectors are nearer than those in a sample, so that is on the safe side."""
    asked = sample[:TRIED]
    own = (sample @ centres.T).argmax(axis=1)
    order = np.argsort(-(asked @ centres.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1, kind="stable")
    near = np.argsort(-(asked @ sample.T), axis=1, kind="stable")[:, 1 : k + 1]
    if not near.size:
        return len(centres)
    ranks = place[np.arange(len(asked))[:, None], own[near]]
    share = np.cumsum(np.bincount(ranks.ravel(), minlength=len(centres))) / ranks.size
    return int(np.searchsorted(share, min(1.0, recall + MARGIN)) + 1)


class CellIndex:
    """Vectors by cell under ``path``: ``model`` (centres, probes), ``cells`` (count and largest angle of what each write added) and ``vectors``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        model = json.loads(spark.read.text(f"{path}/model", wholetext=True).first()[0])
        self.centres, self.probes = np.array(model["centres"]).reshape(-1, model["dim"]), model["probes"]
        self.id_col, self.label_col, self.schema = model["id"], model["label"], model["schema"]

    @classmethod
    def build(cls, vectors: DataFrame, path: str, k: int = 10, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = None, cells: int | None = None) -> CellIndex:
        """Train centres and store all vectors. Null vectors, such of length zero or with null or non-finite entries, and such of another length than most have
        match nothing and aren't stored."""
        spark = vectors.sparkSession
        own = _usable(vectors, id_col, vector_col, label_col)
        sizes = own.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
        dim, n = (sizes["dim"], sizes["n"]) if sizes else (1, 0)
        cells = cells or int(np.clip(np.sqrt(n), 1, MOST))
        wanted = min(SAMPLE, PER_CELL * cells)
        drawn = F.pmod(F.xxhash64("id", "v", F.lit("sample")), F.lit(1 << 40)) / (1 << 40)
        sample = own.where((F.size("v") == dim) & (drawn < (wanted / n if n else 1.0))).select("v").limit(2 * wanted).collect()  # about ``wanted`` rows
        points = unit(np.array([r["v"] for r in sample])) if sample else np.zeros((0, dim))
        points = points[np.lexsort(points.T)]
        np.random.default_rng(SEED).shuffle(points)
        centres = centres_of(points, cells) if len(points) else np.eye(1, dim)
        model = {"dim": dim, "centres": centres.ravel().tolist(), "probes": probes_for(points, centres, k, recall) if len(points) else 1, "id": id_col, "label": label_col, "schema": ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema) + ", angle double, cell int"}
        spark.createDataFrame([(json.dumps(model),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model")
        index = cls(spark, path)
        index._store(own, "overwrite")
        return index

    def add(self, vectors: DataFrame, vector_col: str = "embedding") -> None:
        """Store more vectors in the cells there are."""
        self._store(_usable(vectors, self.id_col, vector_col, self.label_col), "append")

    def _store(self, own: DataFrame, mode: str) -> None:
        """What a cell gets is noted before its vectors are stored, so that a bound is never too small. Hot cells are split by Spark's
        rebalancing, small ones share files' tasks."""
        placed = self._placed(own.where(F.size("v") == self.centres.shape[1]), 1)
        stats = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("angle"))
        stats.coalesce(1).write.mode(mode).parquet(f"{self.path}/cells")
        placed.hint("rebalance", "cell").write.mode(mode).partitionBy("cell").parquet(f"{self.path}/vectors")

    def _placed(self, rows: DataFrame, nearest_cells: int) -> DataFrame:
        """Rows (id, v, label) with their nearest cells: cell and angle, a row for each."""
        centres = self.centres

        def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                m = min(nearest_cells, len(centres))
                for at in strips(len(batch), max(len(centres), m * centres.shape[1])):  # a row goes to m cells with its vector
                    part = batch.iloc[at]
                    near = unit(np.stack(part["v"].to_numpy()).astype(np.float64)) @ centres.T
                    best = np.argsort(-near, axis=1, kind="stable")[:, :m] if m > 1 else near.argmax(axis=1)[:, None]
                    row = np.repeat(np.arange(len(part)), m)
                    out = part.iloc[row].reset_index(drop=True)
                    yield out.assign(cell=best.ravel().astype(np.int32), angle=np.arccos(np.clip(near[row, best.ravel()], -1, 1)))

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        return rows.mapInPandas(run, f"{kinds}, cell int, angle double")

    def cells(self) -> DataFrame:
        """(cell, n, angle): how many vectors each cell has, and their largest angle from the centre."""
        return self.spark.read.schema("cell int, n long, angle double").parquet(f"{self.path}/cells").groupBy("cell").agg(F.sum("n").alias("n"), F.max("angle").alias("angle"))

    def search(self, queries: DataFrame, k: int, probes: int | None = None, exact: bool = False) -> DataFrame:
        """(query_id, id, score, rank) of queries (query_id, vector, [label]) in the nearest ``probes`` cells of each; ``exact``: and in
        all others that can hold anything better. With a label in both queries and index, vectors of that label alone count."""
        labelled = self.label_col is not None and "label" in queries.columns
        asked = queries.select(F.col("query_id").alias("id"), F.col("vector").cast("array<double>").alias("v"), (F.col("label") if labelled else F.lit(0)).alias("label"))
        asked = asked.where(F.col("label").isNotNull() & _finite()).where(F.size("v") == self.centres.shape[1])
        found = self._look(self._placed(asked, probes or self.probes), k, labelled)
        if exact:
            found = self._complete(found, asked, k, probes or self.probes, labelled)
        return top_k(found, k, self.id_col, 5)

    def _look(self, probed: DataFrame, k: int, labelled: bool) -> DataFrame:
        """The k nearest vectors in each question's own cells; only folders of cells that some question asks are read."""
        wanted = [r["cell"] for r in probed.select("cell").distinct().collect()]  # at most the number of cells
        stored = self.spark.read.schema(self.schema).parquet(f"{self.path}/vectors").where(F.col("cell").isin(wanted))
        at = F.struct("cell", "label").cast("string") if labelled else F.col("cell").cast("string")
        near = nearest(probed.select(F.col("id").alias("query_id"), F.col("v").alias("vector"), at.alias("label")), stored.select(F.col("id").alias(self.id_col), "v", at.alias("label")), k, self.id_col, "v", None)
        return top_k(near, k, self.id_col, 15).drop("rank")

    def _complete(self, found: DataFrame, asked: DataFrame, k: int, probes: int, labelled: bool) -> DataFrame:
        """What the cells beyond the probes hold, where the angle between question and centre, less the cell's largest angle, leaves
        room for a score above the k-th found."""
        if probes >= len(self.centres):
            return found
        found = written(found, "neighbours")
        last = found.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
        bounds = {r["cell"]: r["angle"] for r in self.cells().collect()}  # at most the number of cells
        centres, reach = self.centres, np.array([bounds.get(c, -np.inf) for c in range(len(self.centres))])

        def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in strips(len(batch), centres.size):  # a row goes to all cells at most, with its vector
                    part = batch.iloc[at]
                    near = unit(np.stack(part["v"].to_numpy()).astype(np.float64)) @ centres.T
                    order = np.argsort(-near, axis=1, kind="stable")
                    best = (1 + np.cos(np.maximum(0, np.arccos(np.clip(near, -1, 1)) - reach - SLACK))) / 2
                    open_ = (best >= part["least"].fillna(-1).to_numpy()[:, None] - SLACK) & (reach >= 0)
                    np.put_along_axis(open_, order[:, :probes], False, axis=1)
                    row, cell = np.nonzero(open_)
                    yield part.drop(columns="least").iloc[row].reset_index(drop=True).assign(cell=cell.astype(np.int32))

        rows = asked.join(last, "id", "left")
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema)
        return found.union(self._look(rows.mapInPandas(run, f"{kinds}, cell int"), k, labelled))


def _finite():
    return F.coalesce(F.exists("v", lambda x: x != 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def _usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None) -> DataFrame:
    own = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), (F.col(label_col) if label_col else F.lit(0)).alias("label"))
    return own.where(_finite())
