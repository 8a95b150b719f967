"""Queries that run streams over a table to its end: ingestion without repeats, and conversation memory as keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import lexical
from lodestar.plans.catalog import BM25_SQL, ORACLE_SQL, QUERIES, TOP, K
from lodestar.sources.store import shared_path
from lodestar.streaming import ingest


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = spark.read.parquet(f"{sf_dir}/conversations.parquet").schema
    return spark.readStream.schema(kind).parquet(f"{sf_dir}/conversations*.parquet")


def stream_new_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of contents, each once, however often a text comes."""
    path = shared_path(spark, "stream")
    stamped = _turns(spark, sf_dir).withColumn("at", F.timestamp_seconds(F.lit(1_000_000_000)))
    found = ingest.new_content(stamped, "text", "at").select("document_id")
    found.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{path}/out")


def stream_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three turns of each conversation, after the last batch that had any of it."""
    path = shared_path(spark, "stream")
    found = ingest.remembered(_turns(spark, sf_dir).select("conv_id", "turn", "text"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/out/n={number}")

    found.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{path}/out").groupBy("conv_id").agg(F.max_by("turns", "batch").alias("turns"))
    return rows.select("conv_id", F.array_join(F.transform("turns", lambda x: x["turn"].cast("string")), ",").alias("turns"))


def stream_memory_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three turns of each conversation since its last system turn, which clears what came before."""
    path = shared_path(spark, "stream")
    turns, none = _turns(spark, sf_dir), F.lit(None).cast("array<struct<seq:long,text:string>>")
    one = lambda shift, kind: F.struct((2 * F.col("turn") + shift).alias("seq"), F.lit(kind).alias("kind"))
    events = F.when(F.col("role") == "system", F.array(one(0, ingest.CLEAR), one(1, ingest.SAY))).otherwise(F.array(one(1, ingest.SAY)))
    stream = turns.select("conv_id", "text", none.alias("turns"), F.explode(events).alias("e")).select("conv_id", "e.seq", "e.kind", "text", "turns")
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKS)
    try:
        found = ingest.memory_of_events(stream)

        def keep(batch: DataFrame, number: int) -> None:
            batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/out/n={number}")

        found.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(STATE_STORE, before) if before else spark.conf.unset(STATE_STORE)
    rows = spark.read.parquet(f"{path}/out").groupBy("conv_id").agg(F.max_by("turns", "batch").alias("turns"))
    return rows.select("conv_id", F.array_join(F.transform("turns", lambda x: F.floor(x["seq"] / 2).cast("string")), ",").alias("turns"))


#: The state store that keeps lists.
STATE_STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
QUERIES["stream_memory_of_events"] = stream_memory_of_events
ORACLE_SQL["stream_memory_of_events"] = """WITH l AS (SELECT conv_id, max(turn) FILTER (role = 'system') AS cleared FROM conversations GROUP BY conv_id),
r AS (SELECT c.*, row_number() OVER (PARTITION BY c.conv_id ORDER BY turn DESC) AS back FROM conversations c JOIN l ON l.conv_id = c.conv_id WHERE turn >= coalesce(cleared, -1))
SELECT conv_id, string_agg(turn::VARCHAR, ',' ORDER BY turn) AS turns FROM r WHERE back <= 3 GROUP BY conv_id"""


def stream_indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions over the postings of a stream of texts, of which each content is stored and indexed once."""
    path = shared_path(spark, "intake")
    intake = ingest.Intake(spark, path)
    kind = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    intake.run(spark.readStream.schema(kind).parquet(f"{sf_dir}/documents*.parquet").select("text"), f"{path}/state").awaitTermination()
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return lexical.best(asked, intake.log.index(), K)


CONTENTS = "(SELECT DISTINCT substr(sha256(text), 1, 12) AS doc_id, text, '' AS lang, '' AS source FROM documents WHERE text IS NOT NULL)"
QUERIES["stream_indexed_search"] = stream_indexed_search
ORACLE_SQL["stream_indexed_search"] = f"WITH {BM25_SQL.replace('FROM documents', f'FROM {CONTENTS}')} SELECT query_id, doc_id AS document_id, round(score, 6) AS score, {TOP} AS rank FROM scored QUALIFY rank <= 10"
QUERIES["stream_new_content"] = stream_new_content
ORACLE_SQL["stream_new_content"] = "SELECT DISTINCT substr(sha256(text), 1, 12) AS document_id FROM conversations"
QUERIES["stream_memory"] = stream_memory
ORACLE_SQL["stream_memory"] = "WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS back FROM (SELECT DISTINCT conv_id, turn, text FROM conversations)) SELECT conv_id, string_agg(turn::VARCHAR, ',' ORDER BY turn, text) AS turns FROM r WHERE back <= 3 GROUP BY conv_id"
