"""A corpus pipeline: quality, near-duplicates, benchmark contamination, personal data, packing.

Every stage takes the documents its predecessor kept, with all their columns, and its decisions take effect: what it
rejects is gone for the next. Between the stages of ``run`` the documents are written to the shared folder and read again.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weftmap.llm._store import delete_path, materialize, noting_tables, path_of, release
from weftmap.llm.decontamination import decontaminate
from weftmap.llm.packing import pack
from weftmap.llm.personal_data import redact_documents
from weftmap.llm.quality import keep_quality
from weftmap.llm.simhash_dedup import simhash_dedup

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group."""
    return simhash_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by placeholders."""
    return redact_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: The stages can't be told in SQL; tests compare them with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``. A stage's own tables and its input are deleted once its result is stored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with noting_tables() as made:
            kept = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        for path in made:
            if path != path_of(kept):
                delete_path(spark, path)
        release(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
