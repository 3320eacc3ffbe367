"""A training corpus from raw documents, in stages that are each written and read again.

Toxic documents go, one document of each near-duplicate group stays, documents
with benchmark passages go, sources are mixed to target weights along a
curriculum, and token ids are written and read back.

Each stage takes the documents that the one before kept, with all their columns,
and but for the last gives back the same columns with the same names and types,
whatever they are called. Nulls in any column, empty and very long texts, rows
that repeat an id, and empty tables are defined for each stage below.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pairforge.llm import decontaminate, mixing, near_dedup, tokens, toxicity
from pairforge.llm.common import shared_dir, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose score reaches 0.7. Null and empty texts get the score of no words; with no labels of both kinds all stay."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies the document of least id. Null and texts without a word are one group; of rows equal in id and text one stays."""
    return near_dedup.near_deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item. Null and empty texts hold none; with an empty benchmark all stay."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each whole copy that the mix takes, in the order of training. Documents without a word are never taken; a null source is a source like any other."""
    return mixing.mixed_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read back from the token files. Null and empty texts are the end id alone; an empty table gives no rows."""
    return tokens.token_output(docs, tokens.default_tokenizer())


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_output", token_stage),
]

#: The stages learn a classifier and code token ids, which SQL cannot express; tests hold them against plain versions.
ORACLE_SQL = None


#: Rows of whole texts that go to a Python worker at once: the stages work on slices of 2 MB anyway.
BATCH_ROWS = 1_000
_BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over the documents of ``sf_dir``."""
    docs, rows = table(spark, sf_dir, "documents"), spark.conf.get(_BATCHES)
    spark.conf.set(_BATCHES, BATCH_ROWS)
    try:
        for name, stage in STAGES:
            path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    finally:
        spark.conf.set(_BATCHES, rows)
    return docs
