"""The corpus pipeline: from documents to packed training sequences.

``STAGES`` are (name, function) pairs; each function takes (spark, docs,
sf_dir), calls one operator and returns the documents it keeps with their
own columns (the last: packed pieces). Each result is written as Parquet and
read again before the next stage.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meshwork.llm import decontaminate, labelled, packing, pii, quality, simhash
from meshwork.llm.common import materialise, workers_import


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. It learns from
    all labelled documents of the input table but the held-out fifth."""
    labels = _table(spark, sf_dir, "labels").where(~labelled.fold("doc_id", 5, 0))
    return quality.keep_good(docs, labels, threshold=0.3)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates."""
    return simhash.deduplicate(docs, shingle=3, max_bits=3)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark contamination."""
    return decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences of at most 4096."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]

#: Classifier, fingerprints and tokenizer have no SQL form; the tests compare
#: the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``."""
    workers_import(spark)
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
