"""Helpers that the operators share: shared tables and bounded Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch; long texts make large rows.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Where it is unset, a local session gets a new one; on a cluster
    that is an error, as executors don't see each other's own folders."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: With this on, Spark removes the shuffle files of a finished write; it is on while a table is stored.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """``df`` written to a new table in the shared folder and read back; cuts lineage and survives lost executors. Shuffle files of
    the write go when it is done, as the table holds what they were for."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(table: DataFrame) -> None:
    """Delete the files of a table that ``stored`` made and nothing reads any more."""
    sc = table.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(table._stored_at)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows, so that long texts stay within a worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def tokenizer_file(name: str) -> str:
    """A public tokenizer's file on this machine and, at the same place, on the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def map_texts(df: DataFrame, make: Callable[[], Callable[[str], tuple]], columns: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row (id, *result) for each row of ``df``. ``make`` is called once in each task and returns the function of a text;
    a null text counts as empty. Only the id and the text are read; other columns, whatever their names, are left out."""
    small_batches(df.sparkSession)
    source = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    names = [id_col, *(c.split()[0] for c in columns.split(", "))]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = make()
        for batch in batches:
            rows = [one(t) for t in batch["text"]]
            out = {n: [r[k] for r in rows] for k, n in enumerate(names[1:])}
            yield pd.DataFrame({names[0]: batch["id"], **out})

    return source.mapInPandas(run, f"`{id_col}` {id_type}, {columns}")


def list_array(lists: list, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from Python or numpy sequences, without a Python object for each value."""
    import numpy as np

    offsets = np.zeros(len(lists) + 1, np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    dtype = kind.to_pandas_dtype()
    values = np.concatenate([np.asarray(x, dtype) for x in lists]) if lists else np.zeros(0, dtype)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def doc_hash(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def by_group(df: DataFrame, keys: list[str], each: Callable[[tuple, pd.DataFrame], pd.DataFrame | None], schema: str) -> DataFrame:
    """``each(key, rows)`` for every group of rows with equal keys, after one shuffle and sort; a task holds one group at a time.

    For many small groups it is cheaper than applyInPandas, which starts an Arrow stream for each.
    """
    small_batches(df.sparkSession)
    dealt = df.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        last = None
        out: list[pd.DataFrame] = []
        n = 0
        for batch in batches:
            if not len(batch):
                continue
            codes = batch[keys].ne(batch[keys].shift()).any(axis=1).to_numpy()
            codes[0] = True
            starts = [*codes.nonzero()[0].tolist(), len(batch)]
            for a, b in zip(starts, starts[1:], strict=False):
                key = tuple(batch[k].iat[a] for k in keys)
                if last is not None and key != last:
                    made = each(last, pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True))
                    held = []
                    if made is not None and len(made):
                        out.append(made)
                        n += len(made)
                        if n >= BATCH_ROWS:
                            yield pd.concat(out, ignore_index=True)
                            out, n = [], 0
                last = key
                held.append(batch.iloc[a:b])
        if held:
            made = each(last, pd.concat(held, ignore_index=True))
            if made is not None and len(made):
                out.append(made)
        if out:
            yield pd.concat(out, ignore_index=True)

    return dealt.mapInPandas(run, schema)


def forest(n: int, left, right):
    """The smallest member reachable from each of n points over the links left[k]-right[k], as an array."""
    import numpy as np

    label = np.arange(n)
    while True:
        a, b = label[left], label[right]
        apart = a != b
        if not apart.any():
            return label
        least = np.minimum(a, b)[apart]
        np.minimum.at(label, a[apart], least)
        np.minimum.at(label, b[apart], least)
        while (label[label] != label).any():
            label = label[label]
