"""A corpus from raw documents to packed training sequences: five stages, each one operator over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import minhash, packing, quality, secrets, suffix_dedup
from lodestar.llm.common import documents, stored, tokenizer_file

END_ID = 2


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text, where the table has it."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that fail as a whole: those with null or empty texts, too."""
    return _counted(quality.keep_good(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays; null ids stay. Of rows that repeat an id and a text one
    stays; texts without words group with nothing. An empty table stays empty."""
    return minhash.keep_first(docs)


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Characters of strings of 100 bytes that start earlier go; a text may become empty, its row stays. A null text becomes empty."""
    found = suffix_dedup.remove_repeats(docs, 100, whole_characters=True).withColumn("text", F.decode("kept", "UTF-8"))
    return _counted(found.select(*docs.columns))


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each secret gives way to a mark, overlapping ones to one; all rows stay, repeated ones and null texts too. An empty table stays
    empty, as models without samples find nothing."""
    return _counted(secrets.mask(docs))


def window_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their token ids and places in sequences; a null or empty text is its end id alone."""
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"), END_ID, keep_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", near_dedup),
    ("suffix_array_dedup", repeat_removal),
    ("secret_scan", secret_masking),
    ("packing", window_packing),
]

#: SQL can't express trained models and byte-level repeats; tests compare the rows with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; what each keeps is written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
