"""Fit samples and held-out folds of the classifiers."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, folds: int, held: int) -> Column:
    """Whether crc32 of the id as text leaves ``held`` modulo ``folds``
    (false for a null id)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == held, F.lit(False))


def fit_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, limit: int) -> DataFrame:
    """(doc_id, text, label) of at most ``limit`` labelled documents, the
    first in hash order of the id. ``docs`` and ``labels`` hold the rows that
    may be used. Of repeated ids one is taken: the largest label, and of the
    documents (with a column ``own``: those whose own label it is) the one
    whose text has the least hash, whatever their order."""
    ids = (labels.select(F.col(id_col).alias("doc_id"), F.col(label).alias("label")).dropna()
           .groupBy("doc_id").agg(F.max("label").alias("label"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
    rows = docs.join(F.broadcast(ids), "doc_id")
    if "own" in docs.columns:
        rows = rows.where(F.col("own") == F.col("label"))
    hashes = F.struct(F.xxhash64(F.lit(1), "text"), F.xxhash64(F.lit(2), "text"))
    return rows.groupBy("doc_id").agg(F.min_by(F.struct("text", "label"), hashes).alias("x")).select("doc_id", "x.*")
