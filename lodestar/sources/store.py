"""Tables of chunks with vectors, by document: append, scan, list, delete, and reuse of content that is there already."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNKS = "chunk_id string, text string, section_type string, chunk_index int, embedding array<float>, model string, document_id string"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder in that of spark.checkpoint.dir, which all executors share; where that is unset a local session gets one of its own,
    and on a cluster it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: With this on, Spark removes the shuffle files of a finished write.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: what several later steps read is made once, and lost executors cost no more than a step.
    Such tables grow with their input and are small as files, so joins with them are merges: Spark would take them for small and send them
    to the driver and to all executors. Shuffle files of the write go when it is done, so steps don't add up on disk."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path).hint("merge")


def still_there(table: DataFrame) -> bool:
    """Whether a stored table's first file exists."""
    sc = table.sparkSession.sparkContext
    files = table.inputFiles()
    if not files:
        return False
    path = sc._jvm.org.apache.hadoop.fs.Path(files[0])
    return path.getFileSystem(sc._jsc.hadoopConfiguration()).exists(path)


def state(table: DataFrame) -> tuple:
    """(path, size, time) of each file of a table that is read from files: it changes when they do."""
    sc = table.sparkSession.sparkContext
    out = []
    for name in table.inputFiles():
        path = sc._jvm.org.apache.hadoop.fs.Path(name)
        found = path.getFileSystem(sc._jsc.hadoopConfiguration()).getFileStatus(path)
        out.append((name, found.getLen(), found.getModificationTime()))
    return tuple(sorted(out))


class ChunkStore:
    """Parquet partitioned by document; creating it again keeps what is there."""

    def __init__(self, spark: SparkSession, path: str, model: str):
        self.spark, self.path, self.model = spark, path, model
        spark.createDataFrame([], CHUNKS).write.mode("ignore").partitionBy("document_id").parquet(path)

    def _all(self) -> DataFrame:
        return self.spark.read.schema(CHUNKS).parquet(self.path)

    def add(self, chunks: DataFrame) -> None:
        """Append chunks; each needs a vector."""
        checked = chunks.withColumn("embedding", F.when(F.col("embedding").isNull(), F.raise_error(F.lit("a chunk has no vector"))).otherwise(F.col("embedding")))
        names = [c.split()[0] for c in CHUNKS.split(", ")]
        checked.withColumn("model", F.lit(self.model)).select(*names).write.mode("append").partitionBy("document_id").parquet(self.path)

    def chunks(self, document_id: str) -> DataFrame:
        """One document's chunks: a scan of its partition alone. Vectors of another model are an error."""
        other = F.when(F.col("model") != self.model, F.raise_error(F.lit("vectors come from another model"))).otherwise(F.col("model"))
        return self._all().where(F.col("document_id") == document_id).withColumn("model", other)

    def documents(self) -> DataFrame:
        return self._all().select("document_id").distinct()

    def new_documents(self, docs: DataFrame, content_col: str) -> DataFrame:
        """Documents whose content hash isn't stored yet, with ``document_id``."""
        named = docs.withColumn("document_id", content_id(F.col(content_col)))
        return named.join(self.documents(), "document_id", "left_anti").dropDuplicates(["document_id"])

    def delete(self, document_id: str) -> None:
        """Drop one document's partition."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/document_id={document_id}")
        hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def content_id(content):
    return F.substring(F.sha2(content.cast("binary"), 256), 1, 12)


def markdown_table(rows, header):
    """A pipe table of an array of rows (arrays of cells): nulls are empty, line breaks become spaces."""
    cell = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" "))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, cell), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(header, lambda _: F.lit("---")), " | "), F.lit(" |"))
    return F.concat_ws("\n", line(header), rule, F.array_join(F.transform(rows, line), "\n"))
