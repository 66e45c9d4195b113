"""Profiling: counts, distinct values, top values, numeric summaries
(survey ops B1-B10).

Two shared intermediates keep the passes few:

* ``column_stats`` - one wide aggregate (row count, nulls, min, max, mean per
  column): a single scan, partial aggregation, one row per map task shuffled.
* ``value_counts`` - ``(column_name, value, n)`` for every column, nulls kept
  as a value: the one shuffle that feeds distinct counts, top values, allowed
  values, duplicate keys and rare values. Map-side combine collapses hot
  values before the shuffle.

Missing follows pandas: null, and NaN in float columns.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quantiles import exact_quantiles


def q(name: str):
    return F.col(f"`{name}`")


def is_numeric(dtype) -> bool:
    return isinstance(dtype, T.NumericType)


def is_text(dtype) -> bool:
    return isinstance(dtype, (T.StringType, T.VarcharType, T.CharType))


def missing(name: str, dtype):
    """pandas ``isnull``: null, or NaN for float columns."""
    c = q(name)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def as_text(name: str, dtype):
    """Value as text for counting, equal for equal values: NaN becomes null
    like in pandas, -0.0 is 0.0, nested values are JSON (maps with sorted
    keys), so that ["a, b"] and ["a", "b"] differ."""
    c = q(name)
    floats = (T.FloatType, T.DoubleType)
    if isinstance(dtype, floats):
        c = F.when(~F.isnan(c), c + F.lit(0.0).cast(dtype))
    elif isinstance(dtype, T.ArrayType):
        if isinstance(dtype.elementType, floats):
            c = F.transform(c, lambda x: x + F.lit(0.0).cast(dtype.elementType))
        c = F.to_json(c)
    elif isinstance(dtype, T.MapType):
        c = F.to_json(F.array_sort(F.map_entries(c)))
    elif isinstance(dtype, (T.StructType, T.VariantType)):
        c = F.to_json(c)
    return c.cast("string")


def _fields(df: DataFrame, columns=None):
    fields = df.schema.fields
    if columns is not None:
        wanted = set(columns)
        fields = [f for f in fields if f.name in wanted]
    return list(fields)


def schema_table(df: DataFrame) -> DataFrame:
    """(column_name, ordinal, data_type): the schema as a small table."""
    rows = [(f.name, i, f.dataType.simpleString())
            for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(
        rows, "column_name string, ordinal int, data_type string")


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def profile_columns(df: DataFrame) -> DataFrame:
    """B1: per column its position and type, with the table's row count."""
    return schema_table(df).crossJoin(F.broadcast(row_count(df)))


def column_stats(df: DataFrame, columns=None) -> DataFrame:
    """One wide aggregate unpivoted to (column_name, row_count, null_count,
    min_value, max_value, mean_value); the last three only for numbers."""
    fields = _fields(df, columns)
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, f in enumerate(fields):
        aggs.append(F.count_if(missing(f.name, f.dataType)).alias(f"n{i}"))
        if is_numeric(f.dataType):
            x = q(f.name).cast("double")
            x = F.when(~F.isnan(x), x)
            aggs += [F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}"),
                     F.avg(x).alias(f"m{i}")]
    wide = df.agg(*aggs)
    arms = []
    for i, f in enumerate(fields):
        num = is_numeric(f.dataType)
        none = F.lit(None).cast("double")
        arms.append(F.struct(
            F.lit(f.name).alias("column_name"),
            F.lit(i).alias("ordinal"),
            F.col(f"n{i}").alias("null_count"),
            (F.col(f"a{i}") if num else none).alias("min_value"),
            (F.col(f"b{i}") if num else none).alias("max_value"),
            (F.col(f"m{i}") if num else none).alias("mean_value")))
    return wide.select(F.col("__rows").alias("row_count"), F.inline(F.array(*arms)))


def null_counts(df: DataFrame) -> DataFrame:
    """B2: nulls per column."""
    return column_stats(df).select("column_name", "null_count")


def column_profile(df: DataFrame, vc: DataFrame | None = None,
                   allowed: DataFrame | None = None) -> DataFrame:
    """Everything the column-level checks need, from the value counts alone
    (of ``df`` only the schema is used if ``vc`` is given): one scan.

    Without ``vc`` the values are counted under 128-bit hashes; two different
    values of a column share one with probability ``2**-128``.
    The values of a column are first counted by how often they occur, then
    added up per column, so the second shuffle moves a few numbers for each
    number of occurrences. Per column:

    ``row_count, null_count, distinct_count, groups`` (distinct values with
    null as one value), ``in_list`` (rows whose value is allowed),
    ``invalid_count`` (distinct non-null values outside the list) and
    ``rare_count`` (values seen fewer than max(2, 0.1 % of non-null) times).

    The result has one row per column; callers persist it and derive every
    contract, completeness, uniqueness, validity and column score from it.
    """
    side = schema_table(df)
    if allowed is None:
        side = side.withColumn("allowed_values", F.lit(None).cast("array<string>"))
    else:
        side = side.join(allowed.select("column_name", "allowed_values"), "column_name", "left")
    lst = F.col("allowed_values")
    if vc is None:
        column, *value = keys = ["ordinal", "a", "b"]
        cells = _hashed_cells(df).withColumn("n", F.lit(1).cast("bigint"))
        entry = _entry_hashes(df)
    else:
        column, *value = keys = ["column_name", "value"]
        cells, entry = vc.select(*keys, "n"), [F.col("value")]
    if allowed is not None:
        # the lists go through the same grouping as the values: no column comes together in one task
        entries = side.select(column, F.explode(lst).alias("value")).where(F.col("value").isNotNull()).select(
            column, *entry, F.lit(0).cast("bigint").alias("n"), F.lit(1).alias("list"))
        cells = cells.withColumn("list", F.lit(0)).unionByName(entries.where(F.col(value[0]).isNotNull()))
    if vc is None or allowed is not None:
        list_ = [] if allowed is None else [F.max("list").alias("list")]
        cells = cells.groupBy(*keys).agg(F.sum("n").alias("n"), *list_).where(F.col("n") > 0)
    if allowed is None:
        cells = cells.withColumn("list", F.lit(0))
    n, there = F.col("n"), F.col(value[0]).isNotNull()
    by_size = cells.groupBy(column, "n").agg(
        F.count_if(there).alias("values"), F.count(F.lit(1)).alias("sizes"),
        F.count_if(there & (F.col("list") == 1)).alias("listed"))
    by_column = Window.partitionBy(column)
    limit = F.greatest(F.lit(2.0), F.sum(n * F.col("values")).over(by_column) * 0.001)
    per = by_size.withColumn("rare", F.when(n < limit, F.col("values")).otherwise(0)).groupBy(column).agg(
        F.sum(n * F.col("sizes")).alias("row_count"),
        F.sum(n * (F.col("sizes") - F.col("values"))).alias("null_count"),
        F.sum("values").alias("distinct_count"), F.sum("sizes").alias("groups"), F.sum(n * F.col("listed")).alias("in_list"),
        F.sum(F.col("values") - F.col("listed")).alias("outside"), F.sum("rare").alias("rare_count"))
    z = F.lit(0).cast("bigint")
    has_list = lst.isNotNull() & (F.size(lst) > 0)
    # a null entry leaves open what else is allowed
    closed = has_list & ~F.exists(lst, lambda x: x.isNull())
    numbers = ("row_count", "null_count", "distinct_count", "groups", "in_list", "invalid_count", "rare_count")
    return side.join(per, column, "left").withColumn("invalid_count", F.when(closed, F.col("outside"))).select(
        "column_name", "ordinal", "data_type", *(F.coalesce(c, z).cast("bigint").alias(c) for c in numbers),
        "allowed_values", has_list.alias("has_allowed"))


#: Types whose values are equal exactly if their texts are.
_PLAIN = (T.IntegralType, T.FloatType, T.DoubleType, T.DateType, T.TimestampNTZType)


def _normal(value, dtype):
    """-0.0 is 0.0 and NaN is missing."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(value), value + F.lit(0.0).cast(dtype))
    return value


def _hashable(name: str, dtype):
    """A value that is equal where ``as_text`` is, without the text if it can be."""
    return _normal(q(name), dtype) if isinstance(dtype, _PLAIN) else as_text(name, dtype)


def _hashes(value, there=None) -> list:
    """128 bits of a value, null where it is null."""
    there = value.isNotNull() if there is None else there
    return [F.when(there, F.xxhash64(F.lit(seed), value)) for seed in (1, 2)]


def _entry_hashes(df: DataFrame) -> list:
    """The hashes that values of ``df`` with the text ``value`` have in the
    column ``ordinal``; an entry that is no text of its type has none."""
    pairs = []
    for i, f in enumerate(df.schema.fields):
        value = F.col("value")
        same = F.col("ordinal") == i
        if isinstance(f.dataType, _PLAIN):
            typed = _normal(value.try_cast(f.dataType), f.dataType)
            same, value = same & (typed.cast("string") == value), typed
        pairs.append(_hashes(value, same))
    return [F.coalesce(*(pair[k] for pair in pairs)).alias(name) for k, name in enumerate("ab")]


def _hashed_cells(df: DataFrame) -> DataFrame:
    """(ordinal, a, b) for every cell: 20 bytes whatever the value."""
    fields = df.schema.fields
    values = df.select(*(_hashable(f.name, f.dataType).alias(f"v{i}") for i, f in enumerate(fields)))
    hashed = values.select(*(h.alias(f"{name}{i}") for i in range(len(fields)) for h, name in zip(_hashes(F.col(f"v{i}")), "ab")))
    return hashed.select(F.inline(F.array(*(F.struct(
        F.lit(i).alias("ordinal"), F.col(f"a{i}").alias("a"), F.col(f"b{i}").alias("b")) for i in range(len(fields))))))


def column_facts(df: DataFrame, vc: DataFrame | None = None, prof: DataFrame | None = None) -> DataFrame:
    """Counts per column: (column_name, ordinal, data_type, row_count,
    null_count, distinct_count, groups) - a projection of
    :func:`column_profile` (``prof`` if made before)."""
    return (column_profile(df, vc) if prof is None else prof).select("column_name", "ordinal", "data_type", "row_count",
                                         "null_count", "distinct_count", "groups")


def small_cached(df: DataFrame) -> DataFrame:
    """Materialise a small metadata table (one row per column) that many
    branches of a plan read, so its scans and shuffles run once.

    It is checkpointed (eagerly) into the shared folder named by
    ``spark.checkpoint.dir``: later branches read a plain scan, a lost
    executor re-reads the files, and no cache entry is left behind (many
    cached plans slow down every later query's cache lookup). One partition:
    what is derived from it is grouped and joined without an exchange.
    """
    from ..plans.session import cut_lineage
    return cut_lineage(df).coalesce(1)


def value_counts(df: DataFrame, columns=None) -> DataFrame:
    """(column_name, value, n) for all values of the chosen columns; a null
    value stands for the missing cells."""
    fields = _fields(df, columns)
    arms = [F.struct(F.lit(f.name).alias("column_name"),
                     as_text(f.name, f.dataType).alias("value"))
            for f in fields]
    return (df.select(F.inline(F.array(*arms)))
            .groupBy("column_name", "value")
            .agg(F.count(F.lit(1)).alias("n")))


def distinct_counts(df: DataFrame, vc: DataFrame | None = None,
                    exact: bool = True) -> DataFrame:
    """Distinct non-null values per column (pandas ``nunique``).

    Values are shuffled as 128-bit hashes, 24 bytes a distinct value and
    task whatever their length; two different values of a column share one
    with probability ``2**-128``. A value-count table ``vc``, if there is one
    already, is counted instead. ``exact=False`` uses HyperLogLog++ in one wide
    aggregate (no shuffle of values), where an estimate is enough.
    """
    if not exact:
        fields = _fields(df)
        wide = df.agg(*[F.approx_count_distinct(as_text(f.name, f.dataType))
                        .alias(f"d{i}") for i, f in enumerate(fields)])
        arms = [F.struct(F.lit(f.name).alias("column_name"),
                         F.col(f"d{i}").alias("distinct_count"))
                for i, f in enumerate(fields)]
        return wide.select(F.inline(F.array(*arms)))
    if vc is None:
        return _distinct_by_hash(df)
    names = schema_table(df).select("column_name")
    counted = (vc.where(F.col("value").isNotNull()).groupBy("column_name")
               .agg(F.count(F.lit(1)).alias("distinct_count")))
    return (names.join(counted, "column_name", "left")
            .select("column_name",
                    F.coalesce("distinct_count", F.lit(0)).cast("bigint")
                    .alias("distinct_count")))


def _distinct_by_hash(df: DataFrame) -> DataFrame:
    fields = _fields(df)
    arms = []
    for i, f in enumerate(fields):
        value = q(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            value = F.when(~F.isnan(value), value + F.lit(0.0).cast(f.dataType))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            value = as_text(f.name, f.dataType)
        there = value.isNotNull()
        arms.append(F.struct(F.lit(i).alias("i"), F.when(there, F.xxhash64(F.lit(1), value)).alias("a"),
                             F.when(there, F.xxhash64(F.lit(2), value)).alias("b")))
    if not arms:
        return df.sparkSession.createDataFrame([], "column_name string, distinct_count long")
    distinct = df.select(F.inline(F.array(*arms))).where("a is not null").distinct()
    per = distinct.groupBy("i").count()
    # one number per column
    counts = per.agg(F.map_from_entries(F.collect_list(F.struct("i", "count"))).alias("counts"))
    return counts.select(F.inline(F.array(*[F.struct(
        F.lit(f.name).alias("column_name"), F.coalesce(F.try_element_at("counts", F.lit(i)), F.lit(0)).alias("distinct_count"))
        for i, f in enumerate(fields)])))


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_text(f.dataType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def top_values(vc: DataFrame, k: int) -> DataFrame:
    """Non-null values ranked by count (ties by value), first ``k`` per column.

    ``row_number() <= k`` lets Spark insert a partial window group limit before
    the shuffle, so at most ``k`` rows per column leave each map task.
    """
    w = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    return (vc.where(F.col("value").isNotNull())
            .withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k))


def categorical_profile(df: DataFrame, vc: DataFrame | None = None,
                        max_distinct: int = 20, top: int = 10) -> DataFrame:
    """Text columns with at most ``max_distinct`` distinct values: the
    ``top`` most frequent values with their counts."""
    texts = text_columns(df)
    if vc is None:
        vc = value_counts(df, texts)
    dc = (vc.where(F.col("value").isNotNull()).groupBy("column_name")
          .agg(F.count(F.lit(1)).alias("d")).where(F.col("d") <= max_distinct))
    cand = (vc.where(F.col("column_name").isin(texts))
            .join(F.broadcast(dc.select("column_name")), "column_name", "left_semi"))
    return top_values(cand, top).select("column_name", "rank", "value", "n")


def numeric_profile(df: DataFrame, **quantile_kw) -> DataFrame:
    """Min, max, mean, median per numeric column, missing values skipped."""
    nums = numeric_columns(df)
    stats = column_stats(df, nums).select("column_name", "min_value",
                                          "max_value", "mean_value")
    med = (exact_quantiles(df, nums, [0.5], **quantile_kw)
           .select("column_name", F.col("value").alias("median_value")))
    return stats.join(med, "column_name", "left")


def sample_rows(df: DataFrame, n: int = 3, order_by=None) -> DataFrame:
    """The first ``n`` rows by a key (a bounded top-n)."""
    key = order_by or df.columns[0]
    return df.orderBy(key).limit(n)


def result_numeric_summary(df: DataFrame) -> DataFrame:
    """Per numeric column of a (query) result: min, max, mean to 2
    decimals."""
    nums = numeric_columns(df)
    stats = column_stats(df, nums)
    return stats.select("column_name",
                        F.round("min_value", 2).alias("min_value"),
                        F.round("max_value", 2).alias("max_value"),
                        F.round("mean_value", 2).alias("mean_value"))


def column_value_counts(df: DataFrame, column: str, top: int = 20) -> DataFrame:
    """Value counts of one column, nulls dropped, ``top`` most frequent,
    values as text; empty when the column does not exist."""
    spark = df.sparkSession
    if column not in df.columns:
        return spark.createDataFrame([], "value string, n bigint")
    dtype = df.schema[column].dataType
    return (df.select(as_text(column, dtype).alias("value"))
            .where(F.col("value").isNotNull())
            .groupBy("value").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "value").limit(top))


def cross_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts per pair of columns; rows with a null key dropped."""
    return (df.where(~missing(a, df.schema[a].dataType)
                     & ~missing(b, df.schema[b].dataType))
            .groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(a, b))


def column_listing(df: DataFrame, vc: DataFrame | None = None) -> DataFrame:
    """Column, type and distinct count."""
    return (schema_table(df).join(distinct_counts(df, vc), "column_name")
            .select("column_name", "data_type", "distinct_count"))
