"""Fingerprint of a table's content, whatever the order of its rows.

Every row gives two 64-bit hashes (of its values, their positions and its
nulls); the fingerprint holds the number of rows and the exact sums of both.
Equal content gives equal sums in any order and partitioning; a changed, lost,
doubled or added row changes both sums but with a chance of about 2**-128. The
names and types of the columns count too. One scan, and one exchange of one
row per task.
"""
from __future__ import annotations

from decimal import Decimal
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import row_key

SCHEMA = "product string, row_count long, fingerprint string"


def _bits(x: Column, k: int) -> Column:
    """Bits 16k to 16k + 15; the highest with the sign."""
    return F.shiftright(x, 48) if k == 3 else F.shiftright(x, 16 * k).bitwiseAND(F.lit(0xFFFF).cast("long"))


def content_fingerprint(product: str, df: DataFrame) -> DataFrame:
    """One row: product, row_count, fingerprint."""
    first, second, nulls = row_key(df)
    hashes = df.select(first, second, nulls).select(F.xxhash64("_h1", "_nm").alias("a"), F.xxhash64("_nm", "_h2").alias("b"))
    # 16 bits at a time, so that no sum of up to 2**47 rows leaves 64 bits
    parts = [F.sum(_bits(F.col(c), k)).alias(f"{c}{k}") for c in "ab" for k in range(4)]
    sums = hashes.agg(F.count(F.lit(1)).alias("row_count"), *parts).select("row_count", *(reduce(add, (
        F.col(f"{c}{k}").cast("decimal(20,0)") * F.lit(Decimal(1 << 16 * k)) for k in range(4))).alias(c) for c in "ab"))
    columns = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields)
    return sums.select(F.lit(product).alias("product"), "row_count", F.sha2(F.concat_ws(
        "|", F.lit(columns), "row_count", F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))), 256).alias("fingerprint"))
