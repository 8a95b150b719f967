"""Conversation memory as list state: events over restarts from one checkpoint."""

from lodestar.plans.streams import ROCKS, STATE_STORE
from lodestar.streaming import ingest

EVENTS = "conv_id long, seq long, kind string, text string, turns array<struct<seq:long,text:string>>"


def test_memory_over_restarts(spark, tmp_path):
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKS)
    seen = {}

    def run(rows):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        found = ingest.memory_of_events(spark.readStream.schema(EVENTS).parquet(f"file://{tmp_path}/in"))
        each = lambda batch, _: seen.update({r.conv_id: [tuple(t) for t in r.turns] for r in batch.collect()})
        found.writeStream.outputMode("update").option("checkpointLocation", f"file://{tmp_path}/state").foreachBatch(each).trigger(availableNow=True).start().awaitTermination()

    say = lambda c, s, t: (c, s, "say", t, None)
    try:
        run([say(1, 2, "b"), say(1, 1, "a"), say(1, 4, "d"), say(1, 3, "c"), say(2, 1, "x")])
        assert seen == {1: [(2, "b"), (3, "c"), (4, "d")], 2: [(1, "x")]}
        run([say(1, 5, "e"), (2, 2, "clear", None, None), say(2, 3, "y")])
        assert seen == {1: [(3, "c"), (4, "d"), (5, "e")], 2: [(3, "y")]}
        run([(1, 6, "rebuild", None, [(1, "a"), (2, "b"), (3, "c"), (4, "d")]), say(1, 7, "f"), (2, 9, "clear", None, None)])
        assert seen == {1: [(3, "c"), (4, "d"), (7, "f")], 2: []}
        run([say(2, 10, "z"), (1, 8, "rebuild", None, None)])
        assert seen == {1: [], 2: [(10, "z")]}
    finally:
        spark.conf.set(STATE_STORE, before) if before else spark.conf.unset(STATE_STORE)
