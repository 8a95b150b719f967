"""Streams: incremental ingestion without repeats, and conversation memory as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestar.operators.dialogue import HISTORY_TURNS
from lodestar.sources.posting_log import PostingLog
from lodestar.sources.store import content_id


def new_content(stream: DataFrame, content_col: str, time_col: str, keep: str = "1 day") -> DataFrame:
    """Rows whose content hasn't come within ``keep``; state older than the watermark is dropped."""
    named = stream.withColumn("document_id", content_id(F.col(content_col)))
    return named.withWatermark(time_col, keep).dropDuplicatesWithinWatermark(["document_id"])


class Intake:
    """New contents of a stream into a stored table and a log of postings, each once, whatever comes again or fails between.

    A batch's contents are a partition of ``path`` that is named by the stream and the batch, so a batch that is run again writes over its own
    rows alone; the log knows the batches it has. A content that any other batch has stored is used again, not stored twice.
    """

    def __init__(self, spark: SparkSession, path: str, text_col: str = "text"):
        self.spark, self.path, self.text_col = spark, path, text_col
        self.schema = f"document_id string, `{text_col}` string"
        self.log = PostingLog(spark, f"{path}/log", "document_id", "string")
        spark.createDataFrame([], f"{self.schema}, batch string").write.mode("ignore").partitionBy("batch").parquet(f"{path}/contents")

    def contents(self) -> DataFrame:
        """(document_id, text, batch) of all that is stored."""
        return self.spark.read.schema(f"{self.schema}, batch string").parquet(f"{self.path}/contents")

    def take(self, batch: DataFrame, number: int, source: str = "batch") -> None:
        """Store a batch's new contents and their postings; the same (source, number) again adds nothing."""
        name = f"{source}-{number:09d}"
        named = batch.where(F.col(self.text_col).isNotNull()).select(content_id(F.col(self.text_col)).alias("document_id"), self.text_col).dropDuplicates(["document_id"])
        new = named.join(self.contents().where(F.col("batch") != name).select("document_id"), "document_id", "left_anti")
        own = f"{self.path}/contents/batch={name}"
        new.write.mode("overwrite").parquet(own)
        self.log.add(self.spark.read.schema(self.schema).parquet(own), self.text_col, (source, number))
        self.log.compact()

    def run(self, stream: DataFrame, checkpoint: str):
        """Start taking a stream's rows; a restart from the same checkpoint goes on where it was. Batches are numbered by the checkpoint, whose id is their source."""

        def each(batch: DataFrame, number: int) -> None:
            self.take(batch, number, batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId"))

        return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()


def remembered(stream: DataFrame, n: int = HISTORY_TURNS) -> DataFrame:
    """(conv_id, turns): the last n turns (turn, text) of each conversation after each batch; state is n turns a conversation."""

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in state.get[0]] if state.exists else []
        for batch in batches:
            held = sorted({*held, *zip(batch["turn"].tolist(), batch["text"].tolist(), strict=True)})[-n:]
        state.update((held,))
        yield pd.DataFrame({"conv_id": [key[0]], "turns": [[{"turn": t, "text": x} for t, x in held]]})

    turns = "array<struct<turn:long,text:string>>"
    return stream.groupBy("conv_id").applyInPandasWithState(keep, f"conv_id long, turns {turns}", f"turns {turns}", "update", GroupStateTimeout.NoTimeout)


TURN = "seq long, text string"
#: What an event does to a conversation's memory.
SAY, CLEAR, REBUILD = "say", "clear", "rebuild"


class Memory(StatefulProcessor):
    """A conversation's last turns as a list in the state, changed by events; what isn't touched for ``keep`` goes."""

    def __init__(self, n: int, keep: int | None):
        self.n, self.keep = n, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getListState("turns", TURN, *([self.keep] if self.keep else []))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Events of a batch count in the order of ``seq``, whatever order they come in."""
        held = [(int(t[0]), t[1]) for t in self.turns.get()] if self.turns.exists() else []
        for e in sorted((e for batch in rows for e in batch.itertuples(index=False)), key=lambda e: e.seq):
            if e.kind == SAY:
                held.append((int(e.seq), e.text))
            elif e.kind == CLEAR:
                held = []
            elif e.kind == REBUILD:
                held = [(int(t["seq"]), t["text"]) for t in (e.turns if e.turns is not None else [])]
            held = held[-self.n :]
        if held:
            self.turns.put(held)
        else:
            self.turns.clear()
        yield pd.DataFrame({"conv_id": [key[0]], "turns": [[{"seq": s, "text": t} for s, t in held]]})

    def close(self) -> None:
        pass


def memory_of_events(stream: DataFrame, n: int = HISTORY_TURNS, keep_ms: int | None = None) -> DataFrame:
    """(conv_id, turns) after each batch of events (conv_id, seq, kind, text, turns): ``say`` adds a turn, ``clear`` forgets all,
    ``rebuild`` puts its own turns (seq, text) in their place. The state is n turns a conversation, dropped ``keep_ms`` after they were written;
    it needs the state store that keeps lists (RocksDB's)."""
    kind = "processingTime" if keep_ms else "none"
    rows = stream.select("conv_id", "seq", "kind", "text", "turns").groupBy("conv_id")
    return rows.transformWithStateInPandas(Memory(n, keep_ms), "conv_id long, turns array<struct<seq:long,text:string>>", "Update", kind)
