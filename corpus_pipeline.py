"""The corpus pipeline: five stages over ``documents``, each reading what the one before kept.

Defined cases, by the operators behind the stages: null and empty texts are scored, linked and kept like
others; rows with a null id can be rejected by the classifier only, as nothing names them to the later
stages; of rows that repeat an id one stays at near_dedup; a null source is a source of its own. Tables
without rows give none. Extra columns are kept, whatever their names; mixing adds mix_block and mix_slot.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from docspark.llm._common import drop, shared_folder, table
from docspark.llm.decontaminate import decontaminate
from docspark.llm.mixing import mix
from docspark.llm.pii import pseudonymize_table
from docspark.llm.quality import quality_filter
from docspark.llm.simhash import jaccard_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_filter(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays."""
    return jaccard_dedup(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data get pseudonyms."""
    return pseudonymize_table(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its slot in the mix of sources."""
    return mix(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("benchmark_decontamination", benchmark_decontamination), ("pii", pii), ("mixing", mixing)]

#: The classifier and the pseudonyms are not expressible in SQL; a test holds the rows of run() against the stages done by hand.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn; each result is written as Parquet beside the checkpoints and read again by the next, after
    which it goes. The last one stays, as the rows returned are read from it."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if k:
            drop(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
