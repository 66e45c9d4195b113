"""Sources and sinks for data products (survey ops A1-A4).

A product is a named, lazy DataFrame. Its name is the file stem. Discovery
lists the files of one folder (not recursive) with Spark's own file listing,
so it works on any file system the cluster can read.
"""
from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import looks_numeric

# The text tokens pandas' CSV reader turns into missing values
# by default (public pandas behaviour, which the product reader follows).
PANDAS_NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

OUTPUT_PORTS = ("csv", "graph", "api", "parquet", "dataframe")


def product_name(path: str) -> str:
    """Product name = file stem (``/x/telco_churn.csv`` -> ``telco_churn``)."""
    base = posixpath.basename(path.rstrip("/"))
    return base.rsplit(".", 1)[0] if "." in base else base


def _null_tokens_to_null(df: DataFrame, tokens) -> DataFrame:
    cols = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            c = F.when(~c.isin(list(tokens)), c)
        cols.append(c.alias(field.name))
    return df.select(*cols)


def read_product_csv(spark: SparkSession, path: str,
                     null_tokens=PANDAS_NULL_TOKENS,
                     infer_numeric: bool = True) -> DataFrame:
    """Read one CSV product: header row, inferred types, pandas null tokens.

    Fields may be quoted and then hold commas, line breaks and doubled
    quotes, as pandas reads them. Spark takes a single ``nullValue``; the
    other tokens are turned into nulls on text columns afterwards. A text
    column whose non-null values all look like numbers once the tokens are
    gone (``"1.5"``, ``"NA"``) is cast to double, as pandas would read it.
    That check is one aggregation over the text columns; pass
    ``infer_numeric=False`` to skip it.
    """
    df = (spark.read.option("header", True).option("inferSchema", True)
          .option("multiLine", True).option("escape", '"')
          .option("nullValue", "").option("mode", "PERMISSIVE").csv(path))
    df = _null_tokens_to_null(df, null_tokens)
    text_cols = [f.name for f in df.schema.fields
                 if isinstance(f.dataType, T.StringType)]
    if not (infer_numeric and text_cols):
        return df
    text = [F.col(f"`{c}`") for c in text_cols]
    seen = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(text)],
                  *[F.count_if(c.isNotNull() & ~looks_numeric(c)).alias(f"t{i}") for i, c in enumerate(text)]).first()
    numeric = {c for i, c in enumerate(text_cols) if seen[f"n{i}"] and not seen[f"t{i}"]}
    if not numeric:
        return df
    return df.select(*[
        (F.expr(f"try_cast(trim(`{f.name}`) as double)") if f.name in numeric
         else F.col(f"`{f.name}`")).alias(f.name)
        for f in df.schema.fields])


def read_product(spark: SparkSession, path: str, fmt: str = "parquet",
                 **options) -> DataFrame:
    """Read one product in any Spark format (Parquet keeps pushdown)."""
    if fmt == "csv":
        return read_product_csv(spark, path, **options)
    return spark.read.format(fmt).options(**options).load(path)


def _entries(spark: SparkSession, folder: str, suffix: str) -> list[str]:
    """Files and folders directly inside ``folder`` whose name ends with
    ``suffix``, by the file system that Spark reads (one name per product)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [str(s.getPath().toString()) for s in fs.listStatus(path)]
    return sorted(n for n in names if n.endswith(suffix) and not posixpath.basename(n).startswith(("_", ".")))


def discover_products(spark: SparkSession, folder: str,
                      fmt: str = "csv") -> dict[str, DataFrame]:
    """Every ``*.<fmt>`` file (or folder of files) directly inside ``folder``
    becomes a product.

    Returns name -> lazy DataFrame; schemas may differ between files, so each
    is its own read. Works with and without a scheme on any file system that
    Spark reads.
    """
    return {product_name(p): read_product(spark, p, fmt)
            for p in _entries(spark, folder, f".{fmt}")}


def publish_product(registry: dict, name: str, df: DataFrame,
                    contract=None) -> dict:
    """Add or replace one product in a registry dict: its frame, column
    profile, contract columns (``contract``, or inferred from the data), the
    violations of the contract and the invalid values as rows.

    The product is also registered as a temporary view so SQL users can reach
    it by name.
    """
    from ..operators import contract as C
    from ..operators import profile as P
    counts = P.value_counts(df)
    columns = C.infer_contract(name, df, counts) if contract is None else contract
    df.createOrReplaceTempView(name)
    registry[name] = {"df": df, "contract": columns, "profile": P.column_profile(df, counts),
                      "violations": C.contract_violations(name, df, columns, counts),
                      "invalid_values": C.invalid_values(name, df, columns, counts)}
    return registry


def write_product(df: DataFrame, path: str, port: str = "parquet",
                  mode: str = "overwrite", partition_by=None, spec=None):
    """Write a product to one of its output ports.

    ``csv`` and ``parquet`` are file sinks; ``dataframe`` returns the frame
    itself; ``graph`` builds the property graph of ``spec`` and writes its
    node and edge tables.
    """
    if port not in OUTPUT_PORTS:
        raise ValueError(f"unknown output port {port!r}")
    if port == "dataframe":
        return df
    if port == "graph":
        from ..operators import graph as G
        if spec is None:
            raise ValueError("the graph port needs a graph spec")
        G.write_graph(G.build_graph(df, spec), path)
        return path
    if port == "api":
        raise ValueError("the api port is served by an application, not Spark")
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if port == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)
    return path
