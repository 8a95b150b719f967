"""Reports as a stored log of attempts: the first section before the others, resumed where a run stopped, one section made again.

An attempt is a partition of its own, so a run that is repeated writes over its own rows alone, and nothing that is finished is written again. A
section is what its latest attempt made it; one without an attempt is pending.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.answers import borrower_name
from lodestar.functions.plugins import Completer
from lodestar.operators.prompts import generated

#: The section that comes first; what stands for the borrower in the others' prompts, and its name while the first section gives none.
FIRST, MARK, UNKNOWN = 1, "{borrower}", "(Unknown Borrower)"


class ReportStore:
    """Requested sections (report_id, section_number, title, prompt) and their attempts under ``path``."""

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint"):
        self.spark, self.path = spark, path
        self.requests = f"report_id {id_type}, section_number bigint, title string, prompt string"
        self.attempts = f"report_id {id_type}, section_number bigint, title string, body string, status string, error string, attempt int"

    def request(self, prompts: DataFrame) -> None:
        """Ask for sections, each once. Attempts that are there stay."""
        names = [c.split()[0] for c in self.requests.split(", ")]
        prompts.select(*names).write.mode("append").parquet(f"{self.path}/requests")
        self.spark.createDataFrame([], self.attempts).write.mode("ignore").partitionBy("attempt").parquet(f"{self.path}/attempts")

    def _latest(self) -> DataFrame:
        """The latest attempt of each section: a combining aggregation, as attempts are few rows each."""
        rows = self.spark.read.schema(self.attempts).parquet(f"{self.path}/attempts")
        return rows.groupBy("report_id", "section_number").agg(F.max_by(F.struct("body", "status", "error", "attempt"), "attempt").alias("x")).select("report_id", "section_number", "x.*")

    def sections(self) -> DataFrame:
        """(report_id, section_number, title, body, status, error, attempt) of all requested sections."""
        asked = self.spark.read.schema(self.requests).parquet(f"{self.path}/requests").drop("prompt")
        joined = asked.join(self._latest(), ["report_id", "section_number"], "left")
        return joined.withColumn("status", F.coalesce("status", F.lit("pending"))).select("report_id", "section_number", "title", "body", "status", "error", "attempt")

    def _attempt(self, prompts: DataFrame, make: Callable[[], Completer]) -> None:
        """Generate and store under the next number. Prompts are cut to what is asked before the model sees them."""
        last = self.spark.read.schema(self.attempts).parquet(f"{self.path}/attempts").agg(F.max("attempt")).first()[0] or 0
        made = generated(prompts, make).withColumn("attempt", F.lit(last + 1))
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("attempt").parquet(f"{self.path}/attempts")

    def _asked(self, where: Column | None) -> DataFrame:
        asked = self.spark.read.schema(self.requests).parquet(f"{self.path}/requests")
        return asked if where is None else asked.where(where)

    def _named(self, asked: DataFrame) -> DataFrame:
        """Prompts with the borrower that the first section names."""
        first = self._latest().where((F.col("section_number") == FIRST) & (F.col("status") == "complete"))
        names = first.select("report_id", borrower_name(F.col("body")).alias("_name"))
        named = asked.join(names, "report_id", "left")
        return named.withColumn("prompt", F.replace("prompt", F.lit(MARK), F.coalesce("_name", F.lit(UNKNOWN)))).drop("_name")

    def resume(self, make: Callable[[], Completer], where: Column | None = None) -> DataFrame:
        """Make what is pending or failed, of requests ``where`` that holds: first sections in one job, then the others in a second.
        A finished section isn't generated again. Gives all sections."""
        asked = self._asked(where)
        for stage in (F.col("section_number") == FIRST, F.col("section_number") != FIRST):
            finished = self._latest().where("status = 'complete'").select("report_id", "section_number")
            open_ = asked.where(stage).join(finished, ["report_id", "section_number"], "left_anti")
            if not open_.isEmpty():
                self._attempt(self._named(open_), make)
        return self.sections()

    def regenerate(self, make: Callable[[], Completer], where: Column) -> DataFrame:
        """Make the sections that hold again, whatever their state; files of others aren't touched."""
        self._attempt(self._named(self._asked(where)), make)
        return self.sections()
