"""Data contracts: defaults, inference, validation (survey ops C1-C9).

Contracts are two tables:

* ``contracts``        one row per product (owner, team, domain, SLA, ports)
* ``contract_columns`` one row per (product, column): expected type,
  nullable, unique, allowed values, description

Validation joins the contract rows with the profile intermediates of the
data (null counts, value counts), so checking any number of columns costs
the same two passes as profiling.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import profile as P

# Contract defaults of the reference.
DEFAULT_VERSION = "1.0.0"
AUTO_OWNER = "auto-detected"
AUTO_TEAM = "data-platform"
DEFAULT_PORTS = ["csv", "graph", "dataframe"]
SLA_FRESHNESS_HOURS = 24
SLA_AVAILABILITY_PERCENT = 99.0
SLA_MAX_QUERY_TIME_MS = 5000
EXPECT_MIN_COMPLETENESS = 0.95
EXPECT_MIN_UNIQUENESS = 0.0
EXPECT_MIN_VALIDITY = 0.90
EXPECT_MAX_DUPLICATES_PERCENT = 5.0
CATEGORICAL_MAX_DISTINCT = 20

#: A message names the most frequent invalid values of a column up to these
#: bounds and their number; all of them are rows of ``invalid_values``.
MESSAGE_VALUES = 100
MESSAGE_CHARS = 10_000

CONTRACT_SCHEMA = (
    "product string, version string, owner string, team string, "
    "domain string, description string, tags array<string>, "
    "output_ports array<string>, freshness_hours int, "
    "availability_percent double, max_query_time_ms int")
COLUMN_SCHEMA = (
    "product string, column_name string, expected_type string, "
    "nullable boolean, unique boolean, allowed_values array<string>, "
    "description string")


def product_table(spark: SparkSession, names) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "product string")


def default_contract(products: DataFrame) -> DataFrame:
    """The auto-generated contract per product name. Domain is the text
    before the first ``_`` of the name, else ``general``."""
    name = F.col("product")
    domain = F.when(name.contains("_"), F.split_part(name, F.lit("_"), F.lit(1))
                    ).otherwise(F.lit("general"))
    return products.select(
        name.alias("product"), F.lit(DEFAULT_VERSION).alias("version"),
        F.lit(AUTO_OWNER).alias("owner"), F.lit(AUTO_TEAM).alias("team"),
        domain.alias("domain"),
        F.concat(F.lit("Auto-generated contract for "), name).alias("description"),
        F.array(name).alias("tags"),
        F.array(*[F.lit(p) for p in DEFAULT_PORTS]).alias("output_ports"),
        F.lit(SLA_FRESHNESS_HOURS).alias("freshness_hours"),
        F.lit(SLA_AVAILABILITY_PERCENT).alias("availability_percent"),
        F.lit(SLA_MAX_QUERY_TIME_MS).alias("max_query_time_ms"))


def expectations(products: DataFrame) -> DataFrame:
    """Default quality expectations per product."""
    return products.select(
        "product",
        F.lit(EXPECT_MIN_COMPLETENESS).alias("min_completeness"),
        F.lit(EXPECT_MIN_UNIQUENESS).alias("min_uniqueness"),
        F.lit(EXPECT_MIN_VALIDITY).alias("min_validity"),
        F.lit(EXPECT_MAX_DUPLICATES_PERCENT).alias("max_duplicates_percent"))


def column_facts(df: DataFrame, vc: DataFrame | None = None) -> DataFrame:
    return P.column_facts(df, vc)


def infer_contract(product: str, df: DataFrame, vc: DataFrame | None = None,
                   prof: DataFrame | None = None) -> DataFrame:
    """Per column: type, nullable (has a missing value), unique (distinct
    count equals rows), allowed values (distinct values of a text column with
    at most 20 of them, sorted) and a description. ``prof`` is the stored
    column profile of ``df``, if there is one."""
    facts = P.small_cached(column_facts(df, vc)) if prof is None else P.column_facts(df, prof=prof)
    # one row per column decides which columns are counted again, and read
    few = [r["column_name"] for r in facts.where(
        F.col("column_name").isin(P.text_columns(df)) & (F.col("distinct_count") <= CATEGORICAL_MAX_DISTINCT)).collect()]
    allowed = (P.value_counts(df, few).where(F.col("value").isNotNull()).groupBy("column_name")
               .agg(F.array_sort(F.collect_list("value")).alias("allowed_values")) if few else
               df.sparkSession.createDataFrame([], "column_name string, allowed_values array<string>"))
    return (facts.join(allowed, "column_name", "left")
            .select(F.lit(product).alias("product"), "column_name",
                    F.col("data_type").alias("expected_type"),
                    (F.col("null_count") > 0).alias("nullable"),
                    (F.col("distinct_count") == F.col("row_count")).alias("unique"),
                    "allowed_values",
                    F.format_string("Auto-detected: %s, %d unique values",
                                    "data_type", "distinct_count")
                    .alias("description")))


def _pct1(x):
    return F.format_string("%.1f", F.round(x, 1))


def _outside(vc: DataFrame, lists: DataFrame) -> DataFrame:
    """Value counts outside the allowed list of their column."""
    return (vc.where(F.col("value").isNotNull())
            .join(lists.select("column_name", "allowed_values"), "column_name")
            .where(~F.array_contains("allowed_values", F.col("value")))
            .select("column_name", "value", "n"))


def invalid_values(product: str, df: DataFrame, contract_columns: DataFrame,
                   vc: DataFrame | None = None) -> DataFrame:
    """Every distinct non-null value outside the allowed list as a row
    (product, column_name, check, value, n); ``n`` data rows hold it. Values
    are never gathered, so a column may have any number of them."""
    vc = P.value_counts(df) if vc is None else vc
    lists = contract_columns.where((F.col("product") == product) & (F.size("allowed_values") > 0))
    return _outside(vc, lists).select(F.lit(product).alias("product"), "column_name",
                                      F.lit("allowed").alias("check"), "value", "n")


def contract_violations(product: str, df: DataFrame, contract_columns: DataFrame,
                        vc: DataFrame | None = None, prof: DataFrame | None = None) -> DataFrame:
    """One row per violation: (product, column_name, check, message).

    * missing   contract column absent from the data (other checks skipped)
    * nullable  ``nullable=False`` but missing values exist
    * unique    ``unique=True`` but a value repeats (null counts as a value)
    * allowed   non-null values outside the allowed list, listed in order

    Counts come from one column profile (``prof``, if one built with this
    contract's lists is stored);
    only columns with unexpected values go back to the value counts to list
    them. A list of more than ``MESSAGE_VALUES`` values or ``MESSAGE_CHARS``
    characters names the most frequent ones and how many there are in all;
    :func:`invalid_values` has every one as a row.
    """
    cc = contract_columns.where(F.col("product") == product)
    if prof is None:
        prof = P.small_cached(P.column_profile(df, vc, cc.select("column_name", "allowed_values")))
    missing = (cc.join(F.broadcast(P.schema_table(df)), "column_name", "left_anti")
               .select(F.lit(product).alias("product"), "column_name",
                       F.lit("missing").alias("check"),
                       F.concat(F.lit("Missing column: "), "column_name")
                       .alias("message")))
    present = prof.join(cc.select("column_name", "nullable", "unique"), "column_name")
    null_pct = F.try_divide(F.col("null_count"), F.col("row_count")) * 100
    dup_pct = F.try_divide(F.col("row_count") - F.col("groups"), F.col("row_count")) * 100
    arms = F.array(
        F.when(~F.col("nullable") & (F.col("null_count") > 0), F.struct(
            F.lit("nullable").alias("check"),
            F.format_string("%s: has %s%% nulls but nullable=False", "column_name",
                            _pct1(null_pct)).alias("message"))),
        F.when(F.col("unique") & (F.col("groups") < F.col("row_count")), F.struct(
            F.lit("unique").alias("check"),
            F.format_string("%s: has %s%% duplicates but unique=True", "column_name",
                            _pct1(dup_pct)).alias("message"))))
    counted = (present.select("column_name", F.explode(F.filter(arms, lambda a: a.isNotNull()))
                              .alias("v"))
               .select(F.lit(product).alias("product"), "column_name", "v.check", "v.message"))
    bad_cols = prof.where(F.col("has_allowed") & (F.col("invalid_count") > 0)) \
        .select("column_name", "allowed_values", "invalid_count")
    # only columns with unexpected values are counted again, and read at all
    named = [r["column_name"] for r in bad_cols.select("column_name").collect()]
    if not named:
        return missing.unionByName(counted)
    running = Window.partitionBy("column_name").orderBy("rank")
    listed = (P.top_values(_outside(P.value_counts(df, named), bad_cols), MESSAGE_VALUES)
              .withColumn("chars", F.sum(F.length("value") + 2).over(running))
              .where(F.col("chars") <= MESSAGE_CHARS)
              .groupBy("column_name")
              .agg(F.array_sort(F.collect_list("value")).alias("invalid")))
    invalid = F.coalesce("invalid", F.array().cast("array<string>"))
    more = F.when(F.size(invalid) < F.col("invalid_count"), F.array(F.format_string(
        "... (%d values in all)", "invalid_count"))).otherwise(F.array().cast("array<string>"))
    bad = bad_cols.join(F.broadcast(listed), "column_name", "left").select(
        F.lit(product).alias("product"), "column_name",
        F.lit("allowed").alias("check"),
        F.format_string("%s: invalid values [%s] (allowed: [%s])", "column_name",
                        F.array_join(F.concat(invalid, more), ", "),
                        F.array_join("allowed_values", ", ")).alias("message"))
    return missing.unionByName(counted).unionByName(bad)


def contract_status(contracts: DataFrame, violations: DataFrame) -> DataFrame:
    """Per product: version, violation count, compliance flag; products
    without violations stay in (left join)."""
    per = violations.groupBy("product").agg(
        F.count(F.lit(1)).alias("violation_count"),
        F.array_sort(F.collect_list("message")).alias("violations"))
    return (contracts.select("product", F.col("version").alias("contract_version"))
            .join(per, "product", "left")
            .select("product", "contract_version",
                    F.coalesce("violation_count", F.lit(0)).cast("bigint")
                    .alias("violation_count"),
                    F.coalesce("violations", F.array().cast("array<string>"))
                    .alias("violations"),
                    F.coalesce(F.col("violation_count") == 0, F.lit(True))
                    .alias("is_compliant")))


def compliance_report(status: DataFrame) -> DataFrame:
    """Number of products, compliant and non-compliant ones, and the
    status of each product (one small entry per product, sorted)."""
    return status.agg(
        F.count(F.lit(1)).alias("total_products"),
        F.count_if(F.col("is_compliant")).alias("compliant"),
        F.count_if(~F.col("is_compliant")).alias("non_compliant"),
        F.array_sort(F.collect_list(F.struct("product", "is_compliant", "violation_count"))).alias("details"))


def check_expectations(product: str, dims: DataFrame, dup: DataFrame,
                       col_quality: DataFrame,
                       expect: DataFrame | None = None) -> DataFrame:
    """C9 (an addition: the reference declares these thresholds but never
    enforces them): one boolean row per expectation.

    ``dims`` is the quality dimension table, ``dup`` the duplicate-row table
    and ``col_quality`` the per-column quality table of the product.
    """
    spark = dims.sparkSession
    expect = expect if expect is not None else expectations(
        product_table(spark, [product]))
    comp = dims.where(F.col("dimension") == "completeness") \
        .select(F.col("score").alias("completeness"))
    dupr = dup.select(F.col("duplicate_pct"))
    valid = col_quality.agg(F.min("validity").alias("validity"))
    uniq = col_quality.agg(F.max("uniqueness").alias("uniqueness"))
    row = (expect.where(F.col("product") == product)
           .crossJoin(F.broadcast(comp)).crossJoin(F.broadcast(dupr))  # one row each
           .crossJoin(F.broadcast(valid)).crossJoin(F.broadcast(uniq)))
    def arm(name, threshold, actual, passed):
        return F.struct(F.lit(name).alias("expectation"),
                        threshold.cast("double").alias("threshold"),
                        actual.cast("double").alias("actual"),
                        passed.alias("passed"))

    arms = F.array(
        arm("min_completeness", F.col("min_completeness"),
            F.col("completeness") / 100,
            F.col("completeness") / 100 >= F.col("min_completeness")),
        arm("min_uniqueness", F.col("min_uniqueness"), F.col("uniqueness") / 100,
            F.col("uniqueness") / 100 >= F.col("min_uniqueness")),
        arm("min_validity", F.col("min_validity"), F.col("validity") / 100,
            F.col("validity") / 100 >= F.col("min_validity")),
        arm("max_duplicates_percent", F.col("max_duplicates_percent"),
            F.col("duplicate_pct"),
            F.col("duplicate_pct") <= F.col("max_duplicates_percent")))
    return row.select("product", F.inline(arms))


def check_terms(product: str, df: DataFrame, contract_columns: DataFrame, contracts: DataFrame,
                last_modified: DataFrame, as_of=None) -> DataFrame:
    """C9, the other arms, in the columns of :func:`check_expectations`:

    * expected_type  share of the contract's columns (with a type) that the
                     data has in that type; all must
    * max_age_hours  hours from ``last_modified`` (one row) to ``as_of`` (now
                     if null) against the contract's ``freshness_hours``; null
                     if the time of the last change isn't known
    """
    cc = contract_columns.where((F.col("product") == product) & F.col("expected_type").isNotNull())
    own = F.broadcast(P.schema_table(df).select("column_name", "data_type"))
    same = F.coalesce(F.col("data_type") == F.col("expected_type"), F.lit(False))
    share = cc.join(own, "column_name", "left").agg((F.count_if(same) / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("actual"))
    types = share.select(F.lit(product).alias("product"), F.lit("expected_type").alias("expectation"),
                         F.lit(1.0).alias("threshold"), F.col("actual").cast("double"),
                         F.coalesce(F.col("actual") == 1, F.lit(True)).alias("passed"))
    now = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    hours = F.timestamp_diff("MICROSECOND", F.col("last_modified").cast("timestamp"), now) / 3.6e9
    age = contracts.where(F.col("product") == product).crossJoin(last_modified.select(hours.alias("actual"))).select(
        "product", F.lit("max_age_hours").alias("expectation"), F.col("freshness_hours").cast("double").alias("threshold"),
        "actual", (F.col("actual") <= F.col("freshness_hours")).alias("passed"))
    return types.unionByName(age)
