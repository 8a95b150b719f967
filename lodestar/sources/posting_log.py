"""A lexical index as a log of immutable segments: add, delete, follow a changed table, compact; a manifest for each version.

A segment holds the postings and the documents of one change, and the ids whose earlier copies it ends. A row of a segment counts as long as
no later change ends its id. Statistics are sums over the manifest's rows, in which a change that ends documents counts them as
negative, so a version's statistics take no pass over the postings. A version is there once its manifest is, and a manifest is
never written over: of two writers one fails and may try again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import lexical
from lodestar.sources.store import written

MANIFEST = "segment string, seq long, n_docs long, n_tokens long, ended_docs long, ended_tokens long, batches string"
#: A segment joins a merge with the later ones once they are as large as its share of this.
FACTOR = 4


class PostingLog:
    """Segments under ``path``; ``index`` gives what ``lexical.scores`` takes."""

    def __init__(self, spark: SparkSession, path: str, id_col: str = "doc_id", id_type: str = "bigint"):
        self.spark, self.path, self.id_col = spark, path, id_col
        self.postings_schema = f"`{id_col}` {id_type}, token string, dl int, tf long"
        self.docs_schema = f"`{id_col}` {id_type}, dl int, content string"
        self.ended_schema = f"`{id_col}` {id_type}"

    def _fs(self):
        sc = self.spark.sparkContext
        root = sc._jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(sc._jsc.hadoopConfiguration()), sc._jvm.org.apache.hadoop.fs.Path

    def version(self) -> int:
        """The latest version; 0 before the first change."""
        fs, path = self._fs()
        root = path(f"{self.path}/manifest")
        names = [f.getPath() for f in fs.listStatus(root)] if fs.exists(root) else []
        return max([int(p.getName()[2:]) for p in names if fs.exists(path(f"{p.toString()}/_SUCCESS"))], default=0)

    def manifest(self, version: int | None = None) -> list:
        """Rows of a version, a segment each, in the order of changes. Compaction keeps their number in the logarithm of the documents."""
        version = self.version() if version is None else version
        rows = self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest/v={version:09d}").collect() if version else []
        return sorted(rows, key=lambda r: r["seq"])

    def _commit(self, rows: list, version: int) -> None:
        """Write the manifest after ``version``; an error if another writer was first."""
        out = self.spark.createDataFrame([tuple(r) for r in rows], MANIFEST) if rows else self.spark.createDataFrame([], MANIFEST)
        out.coalesce(1).write.mode("errorifexists").json(f"{self.path}/manifest/v={version + 1:09d}")

    def _read(self, rows: list, part: str, schema: str) -> DataFrame:
        """(…, seq) of one part of all segments: postings, docs or ended."""
        out = self.spark.createDataFrame([], f"{schema}, seq long")
        for r in rows:
            out = out.union(self.spark.read.schema(schema).parquet(f"{self.path}/segments/{r['segment']}/{part}").withColumn("seq", F.lit(r["seq"])))
        return out

    def _live(self, rows: list, part: str, schema: str) -> DataFrame:
        """Rows of a part that no later change ends."""
        ended = self._read([r for r in rows if r["ended_docs"] or r["ended_tokens"]], "ended", self.ended_schema).groupBy(self.id_col).agg(F.max("seq").alias("until"))
        held = self._read(rows, part, schema)
        if not any(r["ended_docs"] for r in rows):
            return held
        return held.join(ended, self.id_col, "left").where("until IS NULL OR seq >= until").drop("until")

    def documents(self, version: int | None = None) -> DataFrame:
        """(id, dl, content): the documents of a version, and a hash of each text."""
        return self._live(self.manifest(version), "docs", self.docs_schema).drop("seq")

    def index(self, version: int | None = None) -> lexical.Index:
        """Postings and statistics of a version; earlier ones can be read until they are compacted away."""
        rows = self.manifest(version)
        n = sum(r["n_docs"] - r["ended_docs"] for r in rows)
        tokens = sum(r["n_tokens"] - r["ended_tokens"] for r in rows)
        stats = self.spark.createDataFrame([(n, tokens / n if n else None)], "n_docs long, avgdl double").coalesce(1)
        return lexical.Index(self._live(rows, "postings", self.postings_schema).drop("seq"), stats, self.id_col)

    def change(self, added: DataFrame | None = None, deleted: DataFrame | None = None, text_col: str = "text", batch: tuple[str, int] | None = None) -> int:
        """Add documents (id, text), each once, in place of those of the same id, and end the ids of ``deleted``; one new version, which
        is returned. A ``batch`` (source, number) whose number, or a larger one, the log has seen from that source changes nothing: a stream's
        batch that comes again does no harm."""
        version = self.version()
        rows = self.manifest(version)
        if batch is not None and seen(rows).get(batch[0], -1) >= batch[1]:
            return version
        name, seq = uuid.uuid4().hex, max([r["seq"] for r in rows], default=0) + 1
        at = f"{self.path}/segments/{name}"
        new = added.select(self.id_col, text_col) if added is not None else self.spark.createDataFrame([], f"{self.ended_schema}, `{text_col}` string")
        lexical.counted(new, self.id_col, text_col).write.parquet(f"{at}/postings")
        length = lexical.token_number(F.coalesce(F.col(text_col), F.lit("")))
        new.select(self.id_col, length.alias("dl"), content_hash(F.col(text_col)).alias("content")).write.parquet(f"{at}/docs")
        docs = self.spark.read.schema(self.docs_schema).parquet(f"{at}/docs")
        sums = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("t")).first()
        gone = docs.select(self.id_col)
        gone = gone if deleted is None else gone.union(deleted.select(self.id_col))
        ended = self._live(rows, "docs", self.docs_schema).join(gone.distinct(), self.id_col, "left_semi").select(self.id_col, "dl")
        ended = written(ended, "ended")
        ended.select(self.id_col).write.parquet(f"{at}/ended")
        less = ended.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("t")).first()
        self._commit([*rows, (name, seq, sums["n"], sums["t"], less["n"], less["t"], json.dumps(dict([batch]) if batch else {}))], version)
        return version + 1

    def add(self, docs: DataFrame, text_col: str = "text", batch: tuple[str, int] | None = None) -> int:
        return self.change(docs, None, text_col, batch)

    def delete(self, ids: DataFrame) -> int:
        return self.change(None, ids)

    def sync(self, docs: DataFrame, text_col: str = "text") -> int:
        """Follow a table (id, text), ids once each: what is new or has another text is added, what is gone is deleted. A table without changes makes no version; a log without any takes the table as it is, without a shuffle of texts."""
        if not self.version():
            own = docs.where(F.col(self.id_col).isNotNull())
            return 0 if own.isEmpty() else self.change(own, None, text_col)
        now = docs.select(self.id_col, text_col, content_hash(F.col(text_col)).alias("_now"))
        held = self.documents().select(self.id_col, "content")
        both = now.select(self.id_col, "_now").join(held, self.id_col, "full_outer")
        changed = written(both.where("content IS NULL OR _now IS NULL OR content <> _now"), "changed")
        if changed.isEmpty():
            return self.version()
        new = docs.join(changed.where("_now IS NOT NULL").select(self.id_col), self.id_col, "left_semi")
        return self.change(new, changed.where("_now IS NULL").select(self.id_col), text_col)

    def compact(self, whole: bool = False) -> int:
        """Merge the latest segments, back to the first that is FACTOR times larger than all later ones (``whole``: all), into one
        without ended rows. Sizes then grow geometrically, so a posting is written again a logarithmic number of times."""
        version = self.version()
        rows = self.manifest(version)
        first, size = len(rows), 0
        while first and (whole or first > len(rows) - 1 or rows[first - 1]["n_docs"] < FACTOR * max(1, size)):
            first -= 1
            size += rows[first]["n_docs"]
        if len(rows) - first < 2:
            return version
        kept, merged = rows[:first], rows[first:]
        name, seq = uuid.uuid4().hex, merged[-1]["seq"]
        at = f"{self.path}/segments/{name}"
        self._live(merged, "postings", self.postings_schema).drop("seq").write.parquet(f"{at}/postings")
        self._live(merged, "docs", self.docs_schema).drop("seq").write.parquet(f"{at}/docs")
        ended = self._read(merged, "ended", self.ended_schema).drop("seq").distinct()
        ended = ended if kept else ended.limit(0)
        ended.write.parquet(f"{at}/ended")
        docs = self.spark.read.schema(self.docs_schema).parquet(f"{at}/docs").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("t")).first()
        # documents that the merged changes ended in kept segments are those they ended in all, less those within
        net = sum(r["n_docs"] - r["ended_docs"] for r in merged), sum(r["n_tokens"] - r["ended_tokens"] for r in merged)
        self._commit([*kept, (name, seq, docs["n"], docs["t"], docs["n"] - net[0], docs["t"] - net[1], json.dumps(seen(merged)))], version)
        return version + 1


def seen(rows: list) -> dict[str, int]:
    """The largest number of a batch of each source."""
    out: dict[str, int] = {}
    for r in rows:
        for source, number in json.loads(r["batches"]).items():
            out[source] = max(number, out.get(source, -1))
    return out


def content_hash(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))
