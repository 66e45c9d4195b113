"""Assessments that many results share.

The facts of an assessment (``quality.facts_of``) follow from a product's
content and its contract. They are stored under fingerprints of both, so any
number of results read them as small tables until one of the two changes; to
find out costs one scan of the data and one row per task. Scores, reports,
compliance rules and recommendations are derived from the facts, with the
timeliness of the moment.
"""
from __future__ import annotations

import hashlib
import uuid
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import together
from ..sources.commit_log import CommitLog
from . import quality as D
from .fingerprint import content_fingerprint

_KINDS = tuple(f.name for f in fields(D.Facts))
_SCHEMA = "product string, folder string, stored_at timestamp"


class AssessmentStore:
    """Facts under ``path``, shared by every session that names it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = CommitLog(spark, f"{self.path}/index", _SCHEMA)

    def key(self, product: str, df: DataFrame, contract_columns: DataFrame | None = None) -> str:
        """Identifies the product's present content and contract."""
        def own_contract():
            if contract_columns is None:
                return "none"
            own = contract_columns.where(F.col("product") == product)
            return content_fingerprint(product, own).first()["fingerprint"]
        content, contract = together(lambda: content_fingerprint(product, df).first()["fingerprint"], own_contract)
        return hashlib.sha256(f"{product}|{content}|{contract}".encode()).hexdigest()

    def facts(self, product: str, df: DataFrame, contract_columns: DataFrame | None = None) -> D.Facts:
        """The stored facts, made and stored first where they are missing."""
        key = self.key(product, df, contract_columns)
        if key not in self.log.batches():
            made, folder = D.facts_of(product, df, contract_columns), f"{self.path}/facts-{uuid.uuid4().hex}"
            together(*(lambda k=k: getattr(made, k).coalesce(1).write.parquet(f"{folder}/{k}") for k in _KINDS))
            self.log.commit(key, self.spark.range(1, numPartitions=1).select(
                F.lit(product).alias("product"), F.lit(folder).alias("folder"), F.current_timestamp().alias("stored_at")))
        folder = self.log.read([key]).first()["folder"]
        return D.Facts(*(self.spark.read.parquet(f"{folder}/{k}").coalesce(1) for k in _KINDS))

    def assess(self, product: str, df: DataFrame, contract_columns: DataFrame | None = None,
               last_modified: DataFrame | None = None, as_of=None) -> D.Assessment:
        """As ``quality.assess``; the data are read once for their
        fingerprint, and again only if they or the contract changed."""
        return D.assess(product, df, contract_columns, last_modified, as_of,
                        facts=self.facts(product, df, contract_columns))

    def assess_many(self, products: dict[str, DataFrame], contract_columns: DataFrame | None = None,
                    as_of=None) -> dict[str, D.Assessment]:
        return dict(zip(products, together(*(
            lambda name=name, df=df: self.assess(name, df, contract_columns, None, as_of) for name, df in products.items()))))
