"""Governance: personal-data columns, access policies and decisions, the
read-only query check and compliance rules (survey ops E1-E7).

Decisions are tables; a caller joins or filters on them *before* reading
data (the reference only logs a denial and checks queries after running
them).
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import mutation_keywords, py_list_repr
from ..plans.seeds import DEFAULT_ROLES, PII_PATTERNS, PRIVILEGED_ROLES


def columns_table(spark, products: dict) -> DataFrame:
    """(product, column_name, ordinal) from the products' schemas."""
    rows = [(p, f.name, i) for p, df in products.items()
            for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "product string, column_name string, ordinal int")


def is_pii_name(name: str) -> bool:
    """The same rule for a name that is known when the plan is made."""
    return any(re.search(p, name) for p in PII_PATTERNS)


def pii_pattern_id(name: Column) -> Column:
    """Number (1-based) of the first personal-data pattern the name matches."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(PII_PATTERNS))):
        out = F.when(name.rlike(PII_PATTERNS[i]), F.lit(i + 1)).otherwise(out)
    return out


def detect_pii_columns(columns: DataFrame) -> DataFrame:
    """Columns whose name matches a personal-data pattern."""
    return (columns.withColumn("pattern_id", pii_pattern_id(F.col("column_name")))
            .where(F.col("pattern_id").isNotNull()))


def access_policies(columns: DataFrame) -> DataFrame:
    """Per product: restricted when it has personal-data columns, else
    internal; restricted columns = personal-data columns."""
    tagged = columns.withColumn("pattern_id", pii_pattern_id(F.col("column_name")))
    pii = F.transform(F.array_sort(F.collect_list(F.when(
        F.col("pattern_id").isNotNull(), F.struct("ordinal", "column_name")))),
        lambda s: s["column_name"])
    g = tagged.groupBy("product").agg(pii.alias("pii_columns"))
    return g.select(
        "product",
        F.when(F.size("pii_columns") > 0, F.lit("restricted"))
        .otherwise(F.lit("internal")).alias("access_level"),
        F.array(*[F.lit(r) for r in DEFAULT_ROLES]).alias("allowed_roles"),
        F.col("pii_columns").alias("restricted_columns"), "pii_columns")


def check_access(requests: DataFrame, policies: DataFrame) -> DataFrame:
    """``requests(product, role, columns array)`` -> allowed, reason and
    the restricted columns asked for. No policy -> allowed."""
    j = requests.join(policies, "product", "left")
    restricted = F.filter("columns", lambda c: F.array_contains(
        F.coalesce(F.col("restricted_columns"), F.array().cast("array<string>")), c))
    privileged = F.col("role").isin(*PRIVILEGED_ROLES)
    no_policy = F.col("access_level").isNull()
    role_ok = F.array_contains(F.col("allowed_roles"), F.col("role"))
    allowed = (F.when(no_policy, True).when(~role_ok, False)
               .when((F.size(restricted) > 0) & ~privileged, False).otherwise(True))
    reason = (F.when(no_policy, F.lit("No access policy defined"))
              .when(~role_ok, F.format_string("Role '%s' not in allowed roles: %s",
                                              "role", py_list_repr(F.col("allowed_roles"))))
              .when((F.size(restricted) > 0) & ~privileged,
                    F.format_string("Columns %s are restricted (PII). Role '%s' needs escalation.",
                                    py_list_repr(restricted), "role"))
              .otherwise(F.lit("Access granted")))
    cols = [c for c in requests.columns]
    return j.select(*cols, allowed.alias("allowed"), reason.alias("reason"),
                    F.when(role_ok & ~privileged & (F.size(restricted) > 0), restricted)
                    .alias("restricted_columns"))


def validate_queries(df: DataFrame, text_col: str = "query") -> DataFrame:
    """The read-only check over a column of query texts."""
    found = mutation_keywords(F.col(text_col))
    fail = F.size(found) > 0
    return df.select(
        "*", F.lit("G006").alias("rule_id"),
        F.when(fail, F.lit("fail")).otherwise(F.lit("pass")).alias("status"),
        found.alias("found"),
        F.when(fail, F.concat(F.lit("Query contains mutation operations: "),
                              py_list_repr(found)))
        .otherwise(F.lit("Query is safe (read-only)")).alias("message"),
        F.when(fail, F.lit("error")).otherwise(F.lit("info")).alias("severity"))


RESULT_SCHEMA = ("product string, rule_id string, rule_name string, status string, "
                 "message string, severity string")


def compliance_checks(products: DataFrame, contracts: DataFrame | None,
                      contract_columns: DataFrame | None,
                      policies: DataFrame | None,
                      scores: DataFrame | None) -> DataFrame:
    """E5: rules G001-G005 per product.

    ``products(product)``; ``contracts`` (product, owner, ...);
    ``contract_columns`` (product, description); ``policies`` (product,
    pii_columns); ``scores`` (product, composite_score). G002, G004 and G005
    need a contract, G003 a score.
    """
    spark = products.sparkSession
    empty = lambda s: spark.createDataFrame([], s)
    contracts = contracts if contracts is not None else empty("product string, owner string")
    contract_columns = (contract_columns if contract_columns is not None
                        else empty("product string, description string"))
    policies = policies if policies is not None else empty(
        "product string, pii_columns array<string>")
    scores = scores if scores is not None else empty("product string, composite_score double")
    docs = contract_columns.groupBy("product").agg(
        F.count_if(F.coalesce(F.col("description"), F.lit("")) != "").alias("documented"),
        F.count(F.lit(1)).alias("total"))
    base = (products.select("product")
            .join(contracts.select("product", "owner",
                                   F.lit(True).alias("has_contract")), "product", "left")
            .join(docs, "product", "left")
            .join(policies.select("product", "pii_columns"), "product", "left")
            .join(scores.select("product", "composite_score"), "product", "left"))
    has = F.coalesce(F.col("has_contract"), F.lit(False))
    pii = F.coalesce(F.col("pii_columns"), F.array().cast("array<string>"))
    owner = F.col("owner")
    documented = F.coalesce("documented", F.lit(0))
    total = F.coalesce("total", F.lit(0))

    def res(rule_id, name, status, message, severity, when=F.lit(True)):
        return F.when(when, F.struct(
            F.lit(rule_id).alias("rule_id"), F.lit(name).alias("rule_name"),
            status.alias("status"), message.alias("message"),
            F.lit(severity).alias("severity")))

    arms = F.array(
        res("G001", "Data Contract Required",
            F.when(has, "pass").otherwise("fail"),
            F.when(has, "Data contract exists").otherwise("No data contract defined"), "error"),
        res("G002", "PII Detection", F.when(F.size(pii) == 0, "pass").otherwise("warning"),
            F.when(F.size(pii) == 0, F.lit("No PII detected"))
            .otherwise(F.concat(F.lit("PII columns detected: "), py_list_repr(pii))),
            "warning", has),
        res("G003", "Minimum Quality Score",
            F.when(F.col("composite_score") >= 70, "pass").otherwise("fail"),
            F.format_string("Quality score: %s/100",
                            F.format_string("%.1f", F.round("composite_score", 1))),
            "warning", F.col("composite_score").isNotNull()),
        res("G004", "Schema Documentation",
            F.when(documented == total, "pass").otherwise("warning"),
            F.format_string("%d/%d columns documented", documented, total), "info", has),
        res("G005", "Owner Assignment",
            F.when(owner.isNotNull() & (owner != "") & (owner != "unknown"), "pass")
            .otherwise("fail"),
            F.when(owner != "unknown", F.concat(F.lit("Owner: "), F.coalesce(owner, F.lit(""))))
            .otherwise(F.lit("No owner assigned")), "error", has))
    return (base.select("product", F.explode(F.filter(arms, lambda x: x.isNotNull())).alias("r"))
            .select("product", "r.*"))


def compliance_history(results: DataFrame, checked_at: Column | None = None) -> DataFrame:
    """Per product and check: overall fail when any rule failed
    (warnings pass)."""
    ts = checked_at if checked_at is not None else F.current_timestamp()
    return results.groupBy("product").agg(
        F.when(F.bool_or(F.col("status") == "fail"), "fail").otherwise("pass").alias("overall"),
        F.count(F.lit(1)).alias("rules_checked"),
        F.count_if(F.col("status") == "pass").alias("passed")).withColumn("timestamp", ts)


def compliance_summary(rules: DataFrame, policies: DataFrame,
                       history: DataFrame) -> DataFrame:
    """Counts of global rules, domain rules (in all and per domain),
    policies, personal-data products and checks; the newest check (null
    without any; of equal times the last product by name)."""
    r = rules.agg(F.count_if(F.col("scope") == "global").alias("total_rules"),
                  F.count_if(F.col("scope") == "domain").alias("domain_rules"))
    p = policies.agg(F.count(F.lit(1)).alias("access_policies"),
                     F.array_sort(F.collect_list(F.when(F.size("pii_columns") > 0,
                                                        F.col("product"))))
                     .alias("pii_products"))
    newest = F.max_by(F.struct("product", "overall", "rules_checked", "passed", "timestamp"), F.struct("timestamp", "product"))
    h = history.agg(F.count(F.lit(1)).alias("compliance_checks"), newest.alias("latest_results"))
    d = (rules.where(F.col("scope") == "domain").groupBy("domain").agg(F.count(F.lit(1)).alias("rules"))
         .agg(F.array_sort(F.collect_list(F.struct("domain", "rules"))).alias("rules_by_domain")))
    return r.crossJoin(p).crossJoin(h).crossJoin(d)
