"""Sharding by fixed virtual slots: records hash into slots, bytes add up by slot, and a versioned map gives slots to shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.llm.common import stored

#: Virtual slots: fixed for a data set's lifetime. Maps have as many rows, whatever the data's size.
SLOTS = 8192


def virtual_slot(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a record, by a hash of its key alone; a null key counts as an empty one."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(slots)).cast("int")


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(id, size, text_crc32, vslot) of each row: UTF-8 bytes of the text plus 16; a null text has none."""
    raw = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col), (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"), virtual_slot(F.col(id_col), slots).alias("vslot"))


def slot_sizes(rows: DataFrame) -> DataFrame:
    """Bytes and rows of each slot that has any: partial sums, then a shuffle of at most one row per slot and task."""
    return rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def first_map(sizes: DataFrame, shards: int) -> DataFrame:
    """Version 1 of the map (version, vslot, shard, bytes, rows): the largest slots first, each to the emptiest shard.

    The fold runs over one row per slot, so its input doesn't grow with the data.
    """
    fold = f"""
        aggregate(slots, named_struct('loads', array_repeat(0L, {shards}), 'at', cast(array() as array<int>)),
            (s, x) -> named_struct(
                'loads', transform(s.loads, (v, i) -> if(i = array_position(s.loads, array_min(s.loads)) - 1, v - x.neg, v)),
                'at', array_append(s.at, cast(array_position(s.loads, array_min(s.loads)) - 1 as int))),
            s -> s.at)"""
    slots = sizes.agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("neg"), "vslot", "rows"))).alias("slots"))
    placed = slots.select(F.explode(F.arrays_zip(F.col("slots"), F.expr(fold).alias("shard"))).alias("x"))
    return placed.select(F.lit(1).alias("version"), F.col("x.slots.vslot").alias("vslot"), F.col("x.shard").alias("shard"), (-F.col("x.slots.neg")).alias("bytes"), F.col("x.slots.rows").alias("rows"))


def grow(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version of a map for one shard more: each shard gives up slots while it stays at the new mean or above.

    Slots only move to the new shard ``shards``; all others stay where they are, so only their records have to move.
    """
    mean = F.sum("bytes").over(Window.partitionBy()) / (shards + 1)
    load = F.sum("bytes").over(Window.partitionBy("shard"))
    given = F.sum("bytes").over(Window.partitionBy("shard").orderBy("bytes", "vslot").rowsBetween(Window.unboundedPreceding, 0))
    marked = slot_map.withColumn("moves", load - given >= mean)
    return marked.select((F.col("version") + 1).alias("version"), "vslot", F.when(F.col("moves"), shards).otherwise(F.col("shard")).alias("shard"), "bytes", "rows")


def write_map(slot_map: DataFrame, path: str) -> None:
    """Add a version of a map to those that are stored under ``path``; earlier versions stay."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version of a map: the latest if none is named."""
    stored_maps = spark.read.parquet(path)
    version = stored_maps.agg(F.max("version")).first()[0] if version is None else version
    return stored_maps.where(F.col("version") == version).select("version", "vslot", "shard", "bytes", "rows")


def assign(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``, the gapless place in the shard: slots of a shard one after another, rows of a slot by id.

    The map has at most SLOTS rows and is broadcast. Rows that repeat get places of their own.
    """
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1))
    starts = slot_map.select("vslot", "shard", F.coalesce(before, F.lit(0)).alias("start"))
    key = [c for c in rows.columns if c not in ("vslot",)]
    place = F.row_number().over(Window.partitionBy("vslot").orderBy(*key)) - 1
    return rows.withColumn("place", place).join(F.broadcast(starts), "vslot").withColumn("slot", (F.col("start") + F.col("place")).cast("long")).drop("start", "place")


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows with shard and slot, the stored map) under the law of near-equal bytes.

    Records are reduced to id, size and checksum before anything is shuffled. Equal texts under different ids spread like
    any others. An empty table gives an empty map and no rows; null texts weigh 16 bytes; null ids count as empty ones. Slots of equal
    size go by number, rows of a slot by id, size and checksum; other columns are left out. An id that very many rows
    repeat keeps them in one slot, so such tables don't come out near equal.
    """
    rows = stored(records(docs, id_col, text_col), "shard-records")
    slot_map = stored(first_map(slot_sizes(rows), shards), "slot-map", "version")
    return assign(rows, slot_map), slot_map
