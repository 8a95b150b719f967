"""Stored indexes: neighbours by cells, postings as a log of segments, and a stream's intake."""

import os
import shutil
import time

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from lodestar.operators import lexical
from lodestar.operators.cells import CellIndex
from lodestar.operators.vectors import nearest
from lodestar.plans import catalog
from lodestar.sources import page_dumps as sources
from lodestar.sources.posting_log import PostingLog
from lodestar.sources.store import written
from lodestar.streaming.ingest import Intake


def neighbours(frame):
    return {(r.query_id, r.vec_id, r.score, r["rank"]) for r in frame.collect()}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_the_nearest_cells(spark, sf):
    """The registered query against all pairs; these vectors have hardly any structure, so calibration asks for most of the cells."""
    read = lambda t: spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet")
    found, true = neighbours(catalog.approximate_topk(read)), neighbours(catalog.cosine_topk(read))
    pairs = {x[:2] for x in true}
    assert len({x[:2] for x in found} & pairs) >= 0.95 * len(pairs)
    scores = {x[:2]: x[2] for x in true}
    assert all(scores[x[:2]] == x[2] for x in found if x[:2] in scores)


def test_grouped_vectors_need_few_cells(spark, tmp_path):
    random = np.random.default_rng(3)
    middle = random.normal(size=(40, 16))
    rows = [(i, (middle[i % 40] + 0.1 * random.normal(size=16)).tolist(), i % 3) for i in range(3000)]
    rows += [(9000 + i, x, 0) for i, x in enumerate([None, [0.0] * 16, [float("nan")] * 16, [None] * 16, [1.0], []])]
    first, more = spark.createDataFrame(rows[:2000], "vec_id long, embedding array<double>, label int"), spark.createDataFrame(rows[2000:], "vec_id long, embedding array<double>, label int")
    index = CellIndex.build(first, f"file://{tmp_path}/cells", 5, label_col="label")
    index.add(more)
    every, asked = first.union(more), first.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "label")
    sound = every.where("vec_id < 9000")
    assert index.probes <= len(index.centres) // 3
    assert index.cells().agg(F.sum("n")).first()[0] == 3000
    again = CellIndex(spark, f"file://{tmp_path}/cells")
    true = neighbours(nearest(asked.drop("label"), sound, 5))
    assert neighbours(again.search(asked.drop("label"), 5, probes=1, exact=True)) == true
    assert len({x[:2] for x in neighbours(again.search(asked.drop("label"), 5))} & {x[:2] for x in true}) >= 0.95 * len(true)
    assert neighbours(again.search(asked, 5, exact=True)) == neighbours(nearest(asked, sound, 5))
    assert again.search(asked.limit(0), 5).count() == 0
    assert CellIndex.build(every.limit(0), f"file://{tmp_path}/none").search(asked, 5).count() == 0


TEXTS = [(1, "net income covenant"), (2, "income"), (3, None), (4, "... leverage (ratio) leverage"), (5, "")]


def ranked(spark, of):
    asked = spark.createDataFrame([(1, "income"), (2, "leverage covenant"), (3, "unknown")], "query_id long, query string")
    return sorted((r.query_id, r.doc_id, round(r.score, 9)) for r in lexical.scores(asked, of).collect())


def test_log_of_postings_equals_a_rebuild(spark, tmp_path):
    log = PostingLog(spark, f"file://{tmp_path}/log")
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    now = dict(TEXTS)
    assert log.version() == 0 and ranked(spark, log.index()) == []
    log.add(table(TEXTS[:2]))
    log.add(table(TEXTS[2:]))
    assert ranked(spark, log.index()) == ranked(spark, table(list(now.items())))
    log.delete(table([(2, ""), (99, "")]))
    log.add(table([(1, "leverage income"), (6, "covenant")]))
    before = ranked(spark, log.index(2))
    now.pop(2)
    now.update({1: "leverage income", 6: "covenant"})
    built = lexical.index(table(list(now.items())))
    assert ranked(spark, log.index()) == ranked(spark, built)
    assert log.index().stats.first() == built.stats.first()
    assert before == ranked(spark, table(TEXTS))
    at = log.version()
    assert log.compact(whole=True) == at + 1 and len(log.manifest()) == 1
    assert ranked(spark, log.index()) == ranked(spark, built) and log.index().stats.first() == built.stats.first()
    with pytest.raises(Exception, match="exists"):
        log._commit([], at)


def test_log_notices_a_changed_table(spark, tmp_path):
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    log = PostingLog(spark, f"file://{tmp_path}/log")
    log.sync(table(TEXTS))
    assert log.sync(table(TEXTS)) == 1
    new = [(1, "net income covenant"), (4, "income"), (7, "leverage")]
    assert log.sync(table(new)) == 2
    assert ranked(spark, log.index()) == ranked(spark, table(new))
    assert {r.doc_id for r in log.documents().collect()} == {1, 4, 7}


def test_queries_see_a_rewritten_table(spark, tmp_path):
    for t in ("documents", "benchmark"):
        shutil.copy(f"/root/testdata/sf0.001/{t}.parquet", tmp_path / f"{t}.parquet")
    read = lambda t: spark.read.parquet(f"file://{tmp_path}/{t}.parquet")
    first = {r.doc_id for r in catalog.bm25_topk(read).collect()}
    moved = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("doc_id", F.col("doc_id") + 100_000)
    os.remove(tmp_path / "documents.parquet")
    moved.write.parquet(f"file://{tmp_path}/documents.parquet")
    second = {r.doc_id for r in catalog.bm25_topk(read).collect()}
    assert second == {i + 100_000 for i in first}


def test_intake_takes_each_content_once(spark, tmp_path):
    source, state = tmp_path / "in", f"file://{tmp_path}/state"
    write = lambda rows: spark.createDataFrame([(x,) for x in rows], "text string").coalesce(1).write.mode("append").parquet(f"file://{source}")
    intake = Intake(spark, f"file://{tmp_path}/store")
    run = lambda: intake.run(spark.readStream.schema("text string").parquet(f"file://{source}"), state).awaitTermination()
    texts = lambda: sorted(r.text for r in intake.contents().collect())
    write(["alpha loan", "alpha loan", "beta loan", None])
    run()
    assert texts() == ["alpha loan", "beta loan"]
    write(["beta loan", "gamma loan"])
    run()
    assert texts() == ["alpha loan", "beta loan", "gamma loan"]
    version, batches = intake.log.version(), {r.batch for r in intake.contents().collect()}
    assert len(batches) == 2
    commits = sorted(f for f in os.listdir(tmp_path / "state/commits") if f.isdigit())
    os.remove(tmp_path / "state/commits" / commits[-1])  # as after a failure between the store and the commit
    crc = tmp_path / "state/commits" / f".{commits[-1]}.crc"
    crc.unlink(missing_ok=True)
    run()
    assert texts() == ["alpha loan", "beta loan", "gamma loan"] and {r.batch for r in intake.contents().collect()} == batches
    assert intake.log.documents().count() == 3 and [r["n_docs"] for r in intake.log.manifest()] == [r["n_docs"] for r in intake.log.manifest(version)]
    intake.take(spark.createDataFrame([("delta",), ("beta loan",)], "text string"), 0, "other")
    intake.take(spark.createDataFrame([("delta",), ("beta loan",)], "text string"), 0, "other")
    assert texts() == ["alpha loan", "beta loan", "delta", "gamma loan"]
    built = lexical.index(intake.contents().select("document_id", "text"), "document_id")
    assert intake.log.index().stats.first() == built.stats.first()


@pytest.mark.parametrize("block", ["64b", "1kb", "64mb"])
def test_pages_of_dumps(spark, tmp_path, block):
    """However Spark splits the files, each page has its place in its file; what is written is read again."""
    rng = np.random.default_rng(8)
    texts = ["", None, "é\n漢字 😀\r\nline", "x" * 99, " " * 200, "x" * 100, "two\fpages"]
    pages = [(f"d{d}", p, texts[rng.integers(len(texts))]) for d in range(5) for p in range(1, 1 + 40 * d)]
    frame = spark.createDataFrame(pages, "document string, page int, text string")
    sources.write_pages(frame, f"file://{tmp_path}/dumps")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        found = sources.read_pages(spark, f"file://{tmp_path}/dumps")
        got = sorted((r.path.split("document=")[1].split("/")[0], r.page, r.text, r.needs_ocr) for r in found.collect())
        part = found.where("path LIKE '%document=d3%' AND page > 7").count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [(d, p, (t or "").replace("\f", " ")) for d, p, t in pages]
    assert got == sorted((d, p, t, len(t.strip()) < 100) for d, p, t in want)
    assert part == sum(d == "d3" and p > 7 for d, p, _ in want)


def test_dumps_that_end_without_a_page_end(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("one\ftwo\f\flast".encode())
    (tmp_path / "b.txt").write_bytes(b"")
    got = [(r.path.rsplit("/", 1)[1], r.page, r.text) for r in sources.read_pages(spark, f"file://{tmp_path}").orderBy("page").collect()]
    assert got == [("a.txt", 1, "one"), ("a.txt", 2, "two"), ("a.txt", 3, ""), ("a.txt", 4, "last")]
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        sources.read_pages(spark, f"file://{tmp_path}/missing")


def test_first_sync_takes_the_table_as_it_is(spark, tmp_path, monkeypatch):
    """An empty log has nothing to compare texts with: none are joined or written beside it."""
    monkeypatch.setattr("lodestar.sources.posting_log.written", lambda df, name: pytest.fail(name) if name == "changed" else df)
    log = PostingLog(spark, f"file://{tmp_path}/log")
    assert log.sync(spark.createDataFrame([], "doc_id long, text string")) == 0
    docs = spark.createDataFrame([(1, "lien"), (2, None), (3, ""), (None, "lost")], "doc_id long, text string")
    assert log.sync(docs) == 1
    assert sorted((r.doc_id, r.dl) for r in log.documents().collect()) == [(1, 1), (2, 0), (3, 0)]
    assert [(r.doc_id, r.token) for r in log.index().postings.collect()] == [(1, "lien")]


def test_a_stored_table_leaves_no_shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before = blocks.getAllBlocks().size()
    table = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.collect_list("id").alias("x")), "grouped")
    assert table.count() == 7
    for _ in range(100):
        if blocks.getAllBlocks().size() <= before + 2:  # those of the count itself
            break
        time.sleep(0.1)
    assert blocks.getAllBlocks().size() <= before + 2
