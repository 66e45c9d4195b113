"""The profile of a product that grows by batches.

Publishing a batch counts the batch alone: the values of its columns and its
row keys, as signed counts (``removed`` rows count negative), committed once
under the batch's id (``sources.commit_log``). All counts of one batch are in
one commit, so a reader never sees half of it. The profile of the whole
product is then read from the counts: rows, nulls, distinct values, top and
rare values, least, largest, mean and deviation of numbers, allowed-list hits
and duplicate rows, equal to those of the union of all batches.

The counts are as large as the distinct values and rows; ``compact`` adds up
the batches. Values are shuffled with map-side combine, so a value that a
third of all rows hold is one row per task. Exact quartiles and outliers need
the rows (``profile.numeric_profile``, ``quality.outlier_columns``).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.commit_log import CommitLog
from . import profile as P
from . import quality as D

_SCHEMA = "kind string, column_name string, value string, h1 long, h2 long, n long"


class ProfileState:
    """Counts of the product ``name`` with the columns of ``schema``."""

    def __init__(self, spark: SparkSession, path: str, name: str, schema: StructType):
        self.spark, self.name, self.schema = spark, name, schema
        self.log = CommitLog(spark, path, _SCHEMA)
        #: An empty frame of the product's columns, for what depends on them.
        self.empty = spark.createDataFrame([], schema)

    def _counts(self, rows: DataFrame, sign: int) -> DataFrame:
        rows = rows.select(*(P.q(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields))
        none = F.lit(None)
        values = P.value_counts(rows).select(
            F.lit("value").alias("kind"), "column_name", "value", none.cast("long").alias("h1"),
            none.cast("long").alias("h2"), (F.col("n") * sign).alias("n"))
        keys = rows.select(*D.row_key(rows)).groupBy("_h1", "_h2", "_nm").agg(F.count(F.lit(1)).alias("n")).select(
            F.lit("row").alias("kind"), none.cast("string").alias("column_name"), F.col("_nm").alias("value"),
            F.col("_h1").alias("h1"), F.col("_h2").alias("h2"), (F.col("n") * sign).alias("n"))
        return values.unionByName(keys)

    def commit(self, batch_id: str, added: DataFrame | None = None, removed: DataFrame | None = None) -> bool:
        """Count a batch of rows that came or went. A batch that is committed
        already is not read again (False)."""
        if batch_id in self.log.batches():
            return False
        parts = [self._counts(rows, sign) for rows, sign in ((added, 1), (removed, -1)) if rows is not None]
        rows = self.spark.createDataFrame([], _SCHEMA) if not parts else parts[0]
        for more in parts[1:]:
            rows = rows.unionByName(more)
        return self.log.commit(batch_id, rows)

    @staticmethod
    def _merged(rows: DataFrame) -> DataFrame:
        keys = ("kind", "column_name", "value", "h1", "h2")
        return rows.groupBy(*keys).agg(F.sum("n").alias("n")).where("n <> 0")

    def compact(self) -> bool:
        return self.log.compact(self._merged)

    # -- the profile ---------------------------------------------------------------

    def value_counts(self) -> DataFrame:
        """(column_name, value, n), as ``profile.value_counts`` of all rows."""
        rows = self.log.read().where("kind = 'value'")
        return rows.groupBy("column_name", "value").agg(F.sum("n").alias("n")).where("n <> 0")

    def column_stats(self) -> DataFrame:
        """As ``profile.column_stats``, with the deviation of numbers."""
        numbers = P.numeric_columns(self.empty)
        x = F.when(F.col("column_name").isin(numbers), F.col("value").try_cast("double"))
        n = F.col("n")
        per = self.value_counts().groupBy("column_name").agg(
            F.sum(n).alias("row_count"), F.coalesce(F.sum(F.when(F.col("value").isNull(), n)), F.lit(0)).alias("null_count"),
            F.min(x).alias("min_value"), F.max(x).alias("max_value"),
            (F.sum(x * n) / F.sum(F.when(x.isNotNull(), n))).alias("mean_value"))
        z = F.lit(0).cast("long")
        return P.schema_table(self.empty).select("column_name", "ordinal").join(per, "column_name", "left").select(
            F.coalesce("row_count", z).alias("row_count"), "column_name", "ordinal",
            F.coalesce("null_count", z).alias("null_count"), "min_value", "max_value", "mean_value")

    def deviations(self) -> DataFrame:
        """(column_name, std_value): sample deviation of the numbers, from
        squares about the mean."""
        mean = self.column_stats().select("column_name", "mean_value").where("mean_value is not null")
        x, n = F.col("value").try_cast("double"), F.col("n")
        return self.value_counts().where("value is not null").join(F.broadcast(mean), "column_name").groupBy("column_name").agg(
            F.sqrt(F.try_divide(F.sum(n * (x - F.col("mean_value")) * (x - F.col("mean_value"))), F.sum(n) - 1)).alias("std_value"))

    def profile(self, allowed: DataFrame | None = None) -> DataFrame:
        """As ``profile.column_profile`` of all rows: what contract and
        quality checks read."""
        return P.column_profile(self.empty, self.value_counts(), allowed)

    def top_values(self, k: int = 10) -> DataFrame:
        return P.top_values(self.value_counts(), k)

    def duplicate_rows(self) -> DataFrame:
        """As ``quality.duplicate_rows`` of all rows."""
        groups = self.log.read().where("kind = 'row'").groupBy("h1", "h2", "value").agg(F.sum("n").alias("n")).where("n > 0")
        return D.duplicates_of_groups(self.name, groups)

    def completeness(self) -> DataFrame:
        return D.completeness_dimension(self.name, self.empty, P.small_cached(self.profile()))

    def rare_values(self) -> DataFrame:
        return D.rare_value_columns(self.name, self.empty, self.value_counts().where(
            F.col("column_name").isin(P.text_columns(self.empty))))

    def column_quality(self, contract_columns: DataFrame | None = None) -> DataFrame:
        return D.column_quality(self.name, self.empty, contract_columns,
                                facts=self.profile(D.allowed_lists(self.name, contract_columns)))
