"""Catalog and active metadata: column and product entries, change log,
quality badges and drop alerts, usage statistics, recommendations
(survey ops M1-M9)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.commit_log import CommitLog
from . import profile as P

QUALITY_DROP_POINTS = 10
LOW_SCORE = 70
NULL_ALERT_PCT = 20
BUSY_QUERIES = 10


def catalog_columns(product: str, df: DataFrame, vc: DataFrame | None = None) -> DataFrame:
    """M1: per column type, distinct count, null count and up to five of the
    most frequent values of categorical text columns."""
    vc = P.value_counts(df) if vc is None else vc
    facts = P.column_facts(df, vc)
    top = (P.categorical_profile(df, vc).where(F.col("rank") <= 5)
           .groupBy("column_name")
           .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))),
                            lambda s: s["value"]).alias("sample_values")))
    return (facts.join(top, "column_name", "left")
            .select(F.lit(product).alias("product"), "column_name", "ordinal", "data_type",
                    F.col("distinct_count").alias("nunique"), "null_count",
                    F.coalesce("sample_values", F.array().cast("array<string>"))
                    .alias("sample_values")))


def catalog_products(entries: DataFrame, contracts: DataFrame | None = None,
                     status: DataFrame | None = None) -> DataFrame:
    """M2: ``entries(product, file_path, row_count, column_count)`` with
    owner, domain, tags and contract compliance; ``unknown`` / ``general``
    when there is no contract."""
    spark = entries.sparkSession
    if contracts is None:
        contracts = spark.createDataFrame(
            [], "product string, owner string, domain string, tags array<string>")
    if status is None:
        status = spark.createDataFrame([], "product string, is_compliant boolean")
    return (entries.join(contracts.select("product", "owner", "domain", "tags"), "product", "left")
            .join(status.select("product", F.col("is_compliant").alias("contract_compliant")),
                  "product", "left")
            .select("product", "file_path", "row_count", "column_count",
                    F.coalesce("owner", F.lit("unknown")).alias("owner"),
                    F.coalesce("domain", F.lit("general")).alias("domain"),
                    F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
                    "contract_compliant"))


def change_log(entries: DataFrame, at=None) -> DataFrame:
    """M3: one ``register`` row per registered product."""
    ts = F.current_timestamp() if at is None else F.lit(at).cast("timestamp")
    return entries.select(F.lit("register").alias("action"), "product",
                          ts.alias("timestamp"), F.col("row_count").alias("rows"),
                          F.col("column_count").alias("columns"))


def quality_badge(products: DataFrame, report: DataFrame) -> DataFrame:
    """M4: the newest score and grade put on each product."""
    r = report.select("product", F.col("composite_score").alias("quality_score"),
                      F.col("grade").alias("quality_grade"))
    return products.join(r, "product", "left")


def quality_drop_alerts(history: DataFrame) -> DataFrame:
    """M5: ``history(product, assessed_at, score)``: an alert when a score is
    more than 10 points below the previous one of the same product."""
    w = Window.partitionBy("product").orderBy("assessed_at")
    h = history.withColumn("previous", F.lag("score").over(w))
    return (h.where(F.col("previous").isNotNull()
                    & (F.col("score") < F.col("previous") - QUALITY_DROP_POINTS))
            .select(F.lit("quality_drop").alias("alert_type"),
                    F.lit("warning").alias("severity"), "product", "assessed_at",
                    F.format_string("Quality dropped from %s to %s",
                                    F.format_string("%.1f", F.round("previous", 1)),
                                    F.format_string("%.1f", F.round("score", 1)))
                    .alias("message")))


USAGE_SCHEMA = ("product string, query string, columns_accessed array<string>, "
                "user_role string, timestamp timestamp")


def usage_rows(runs: DataFrame) -> DataFrame:
    """M6: usage rows of ``runs(query, products, relevant_columns, user_role,
    timestamp)``, ``relevant_columns`` a map of product to columns: one row
    per product used, each with the columns of all products (T17, as in the
    reference); runs without products have none; the role is ``analyst`` if
    null."""
    columns = F.coalesce(F.flatten(F.map_values("relevant_columns")), F.array().cast("array<string>"))
    return runs.select(F.explode("products").alias("product"), "query", columns.alias("columns_accessed"),
                       F.coalesce("user_role", F.lit("analyst")).alias("user_role"), "timestamp")


def record_usage(usage_log: DataFrame, path: str) -> None:
    """M6: append a batch of usage rows (see ``usage_rows``) to the usage
    table. A retry appends them again; ``commit_usage`` does not."""
    usage_log.write.mode("append").parquet(path)


def committed_usage(spark: SparkSession, path: str) -> CommitLog:
    """M6: the usage log under ``path`` whose batches count once."""
    return CommitLog(spark, path, USAGE_SCHEMA)


def commit_usage(usage: DataFrame, path: str, batch_id: str) -> bool:
    """M6: append a batch of usage rows unless batch ``batch_id`` is already
    in the log (then False), so that a batch may be retried at will."""
    return committed_usage(usage.sparkSession, path).commit(batch_id, usage)


def top_products(usage_log: DataFrame, k: int = 5) -> DataFrame:
    """M7: most used products (ties by name)."""
    return (usage_log.groupBy("product").agg(F.count(F.lit(1)).alias("queries"))
            .orderBy(F.desc("queries"), "product").limit(k))


def top_columns(usage_log: DataFrame, k: int = 10) -> DataFrame:
    """M7: most used columns (ties by name)."""
    return (usage_log.select(F.explode("columns_accessed").alias("column_name"))
            .groupBy("column_name").agg(F.count(F.lit(1)).alias("uses"))
            .orderBy(F.desc("uses"), "column_name").limit(k))


def usage_summary(usage_log: DataFrame) -> DataFrame:
    """M7: total queries and the distinct roles."""
    return usage_log.agg(F.count(F.lit(1)).alias("total_queries"),
                         F.array_sort(F.collect_set("user_role")).alias("roles"))


def recommendations(products: DataFrame, columns: DataFrame,
                    usage_log: DataFrame | None = None) -> DataFrame:
    """M8: rule-based advice per product.

    ``products(product, row_count, quality_score, quality_grade, owner,
    contract_compliant)``; ``columns(product, column_name, null_count)``.
    The usage rule looks at all products' usage, as in the reference.
    """
    spark = products.sparkSession
    if usage_log is None:
        usage_log = spark.createDataFrame([], USAGE_SCHEMA)
    nulls = (columns.join(products.select("product", "row_count"), "product")
             .withColumn("pct", F.when(F.col("row_count") > 0,
                                       F.col("null_count") / F.col("row_count") * 100)
                         .otherwise(F.lit(0.0)))
             .where(F.col("pct") > NULL_ALERT_PCT)
             .select("product", F.lit("nulls").alias("rule"),
                     F.format_string("Column '%s' has %s%% nulls — consider imputation",
                                     "column_name", F.format_string("%.0f", F.round("pct", 0)))
                     .alias("message")))
    total = usage_log.agg(F.count(F.lit(1)).alias("total_queries"))
    popular = top_columns(usage_log, 5).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(
            F.struct(-F.col("uses"), F.col("column_name")))), lambda s: s["column_name"]),
            ", ").alias("popular"))
    p = products.crossJoin(total).crossJoin(popular)
    score = F.col("quality_score")
    def rule(cond, name, message):
        return F.when(cond, F.struct(F.lit(name).alias("rule"), message.alias("message")))

    arms = F.array(
        rule(score.isNotNull() & (score < LOW_SCORE), "low_score",
             F.format_string("Quality score is %s/100 — investigate data issues",
                             F.format_string("%.1f", F.round(score, 1)))),
        rule(score.isNotNull() & F.col("quality_grade").isin("D", "F"), "low_grade",
             F.lit("Quality grade is below acceptable threshold — data contract review needed")),
        rule(F.col("contract_compliant") == F.lit(False), "contract",
             F.lit("Data contract violations detected — review contract compliance")),
        rule(F.col("owner").isin("unknown", "auto-detected"), "owner",
             F.lit("No owner assigned — assign a domain owner for accountability")),
        rule((F.col("total_queries") > BUSY_QUERIES) & (F.col("popular") != ""), "usage",
             F.format_string("Most queried columns: %s — consider pre-aggregation", "popular")))
    rules = (p.select("product", F.explode(F.filter(arms, lambda x: x.isNotNull())).alias("r"))
             .select("product", "r.rule", "r.message"))
    return rules.unionByName(nulls)


def catalog_entries(products: DataFrame, columns: DataFrame) -> DataFrame:
    """M9: per product its rows, number of columns and their names in order
    (one small list per product)."""
    names = columns.groupBy("product").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("ordinal", "column_name"))), lambda c: c["column_name"]).alias("columns"))
    return products.join(names, "product", "left").select(
        "product", "row_count", F.coalesce(F.size("columns"), F.lit(0)).cast("bigint").alias("column_count"), "columns")


def catalog_summary(products: DataFrame, columns: DataFrame, usage_log: DataFrame,
                    alerts: DataFrame, changes: DataFrame) -> DataFrame:
    """M9: counts of products, columns, rows, queries, alerts and changes."""
    a = products.agg(F.count(F.lit(1)).alias("total_products"),
                     F.sum("row_count").cast("bigint").alias("total_rows"))
    b = columns.agg(F.count(F.lit(1)).alias("total_columns"))
    c = usage_log.agg(F.count(F.lit(1)).alias("total_queries"))
    d = alerts.agg(F.count(F.lit(1)).alias("active_alerts"))
    e = changes.agg(F.count(F.lit(1)).alias("change_log_entries"))
    return a.crossJoin(b).crossJoin(c).crossJoin(d).crossJoin(e)
