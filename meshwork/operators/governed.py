"""Reads that follow the access policies (E3, applied to data).

A decision is made before the data is touched and becomes part of the plan:
what a role may not see is not read. ``governed_read`` refuses a role that the
policy does not name; a restricted column that the role may not see raw is

* refused (the read fails, as ``governance.check_access`` decides),
* left out of the result, or
* replaced by a mask. ``null`` and ``constant`` masks don't need the column,
  so it is not in the scan either; ``hash``, ``last4`` and ``initial`` compute
  their value inside the scan's projection.

The result exposes the mask only: filters, joins and groupings behind it work
on masked values. Policies are metadata of a few columns per product; the one
of the product is read on the driver.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .governance import check_access


class AccessRefused(PermissionError):
    """The policy does not let the role read what it asked for."""


def _digest(column: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt), column.cast("string")), 256)


def _last4(column: Column, salt: str) -> Column:
    text = column.cast("string")
    return F.when(F.length(text) > 4, F.concat(F.lit("***"), F.right(text, F.lit(4)))).when(text.isNotNull(), "***")


#: Mask -> text from (column, salt); nulls stay null but under ``constant``.
#: The mask ``null`` keeps the column's type.
MASKS = {
    "hash": _digest,
    "last4": _last4,
    "initial": lambda c, _: F.when(c.isNotNull(), F.concat(F.left(c.cast("string"), F.lit(1)), F.lit("***"))),
    "constant": lambda c, _: F.lit("***"),
}


def decide(product: str, role: str, columns: list[str], policies: DataFrame) -> dict:
    """The decision of ``check_access`` on one request: allowed, reason and
    the restricted columns among those asked for."""
    spark = policies.sparkSession
    request = spark.createDataFrame([(product, role, columns)], "product string, role string, columns array<string>")
    # the one product's policy decides; the data is not looked at
    row = check_access(request, policies.where(F.col("product") == product)).first()
    return {"allowed": row["allowed"], "reason": row["reason"], "restricted": list(row["restricted_columns"] or [])}


def governed_read(df: DataFrame, product: str, role: str, policies: DataFrame, columns: list[str] | None = None,
                  restricted: str | dict[str, str] = "refuse", salt: str = "") -> DataFrame:
    """``columns`` (all, in the table's order) of a product as ``role`` may
    see them.

    ``restricted``: what becomes of restricted columns for a role that is not
    privileged: ``refuse``, ``drop``, the name of a mask, or a dict from column
    to one of these (``*`` for the others, else refuse). Raises
    ``AccessRefused`` where the policy refuses.
    """
    columns = list(df.columns) if columns is None else list(columns)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no columns {missing} in {product!r}")
    decision = decide(product, role, columns, policies)
    hidden = set(decision["restricted"])
    if not decision["allowed"] and not hidden:
        raise AccessRefused(decision["reason"])
    ways = restricted if isinstance(restricted, dict) else {"*": restricted}
    out = []
    for name in columns:
        way = ways.get(name, ways.get("*", "refuse")) if name in hidden else "show"
        column = F.col("`" + name.replace("`", "``") + "`")
        if way == "refuse":
            raise AccessRefused(decision["reason"])
        if way == "show":
            out.append(column)
        elif way == "null":
            out.append(F.lit(None).cast(df.schema[name].dataType).alias(name))
        elif way in MASKS:
            out.append(MASKS[way](column, salt).alias(name))
        elif way != "drop":
            raise ValueError(f"unknown mask {way!r}")
    return df.select(*out)


def read_or_none(df: DataFrame, *args, **kwargs) -> DataFrame | None:
    """``governed_read``, or None where the policy refuses."""
    try:
        return governed_read(df, *args, **kwargs)
    except AccessRefused:
        return None
